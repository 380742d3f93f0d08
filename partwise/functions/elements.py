"""Properties of the elements. Sets of formula features look them up; other tables can be registered in their place."""

from __future__ import annotations

# Of each element its number, mass, electronegativity (Pauling), covalent radius (pm), electron affinity and ionisation
# energy (kJ/mol); then single properties, by element in the order of their numbers; then groups of elements.
PROPERTIES = ["atomic_number", "atomic_mass", "electronegativity", "covalent_radius", "electron_affinity", "ionization_energy"]
ELEMENTS = {
    "H": (1, 1.008, 2.2, 31, 72.8, 1312.0),
    "He": (2, 4.003, 0.0, 28, 0.0, 2372.3),
    "Li": (3, 6.941, 0.98, 128, 59.6, 520.2),
    "Be": (4, 9.012, 1.57, 96, 0.0, 899.5),
    "B": (5, 10.81, 2.04, 84, 26.7, 800.6),
    "C": (6, 12.011, 2.55, 76, 121.8, 1086.5),
    "N": (7, 14.007, 3.04, 71, 0.0, 1402.3),
    "O": (8, 15.999, 3.44, 66, 141.0, 1313.9),
    "F": (9, 18.998, 3.98, 57, 328.0, 1681.0),
    "Ne": (10, 20.18, 0.0, 58, 0.0, 2080.7),
    "Na": (11, 22.99, 0.93, 166, 52.8, 495.8),
    "Mg": (12, 24.305, 1.31, 141, 0.0, 737.7),
    "Al": (13, 26.982, 1.61, 121, 42.5, 577.5),
    "Si": (14, 28.086, 1.9, 111, 134.1, 786.5),
    "P": (15, 30.974, 2.19, 107, 72.0, 1011.8),
    "S": (16, 32.06, 2.58, 105, 200.4, 999.6),
    "Cl": (17, 35.45, 3.16, 102, 349.0, 1251.2),
    "Ar": (18, 39.948, 0.0, 106, 0.0, 1520.6),
    "K": (19, 39.098, 0.82, 203, 48.4, 418.8),
    "Ca": (20, 40.078, 1.0, 176, 2.4, 589.8),
    "Sc": (21, 44.956, 1.36, 170, 18.1, 633.1),
    "Ti": (22, 47.867, 1.54, 160, 7.6, 658.8),
    "V": (23, 50.942, 1.63, 153, 50.9, 650.9),
    "Cr": (24, 51.996, 1.66, 139, 64.3, 652.9),
    "Mn": (25, 54.938, 1.55, 139, 0.0, 717.3),
    "Fe": (26, 55.845, 1.83, 132, 15.7, 762.5),
    "Co": (27, 58.933, 1.88, 126, 63.7, 760.4),
    "Ni": (28, 58.693, 1.91, 124, 112.0, 737.1),
    "Cu": (29, 63.546, 1.9, 132, 118.4, 745.5),
    "Zn": (30, 65.38, 1.65, 122, 0.0, 906.4),
    "Ga": (31, 69.723, 1.81, 122, 41.0, 578.8),
    "Ge": (32, 72.63, 2.01, 120, 119.0, 762.2),
    "As": (33, 74.922, 2.18, 119, 78.2, 947.0),
    "Se": (34, 78.96, 2.55, 120, 195.0, 941.0),
    "Br": (35, 79.904, 2.96, 120, 324.6, 1139.9),
    "Kr": (36, 83.798, 3.0, 116, 0.0, 1350.8),
    "Rb": (37, 85.468, 0.82, 220, 46.9, 403.0),
    "Sr": (38, 87.62, 0.95, 195, 5.0, 549.5),
    "Y": (39, 88.906, 1.22, 190, 29.6, 600.0),
    "Zr": (40, 91.224, 1.33, 175, 41.1, 640.1),
    "Nb": (41, 92.906, 1.6, 164, 86.1, 652.1),
    "Mo": (42, 95.96, 2.16, 154, 71.9, 684.3),
    "Ru": (44, 101.07, 2.2, 146, 101.3, 710.2),
    "Rh": (45, 102.91, 2.28, 142, 109.7, 719.7),
    "Pd": (46, 106.42, 2.2, 139, 53.7, 804.4),
    "Ag": (47, 107.87, 1.93, 145, 125.6, 731.0),
    "Cd": (48, 112.41, 1.69, 144, 0.0, 867.8),
    "In": (49, 114.82, 1.78, 142, 28.9, 558.3),
    "Sn": (50, 118.71, 1.96, 139, 107.3, 708.6),
    "Sb": (51, 121.76, 2.05, 139, 103.2, 834.0),
    "Te": (52, 127.6, 2.1, 138, 190.2, 869.3),
    "I": (53, 126.9, 2.66, 139, 295.2, 1008.4),
    "Xe": (54, 131.29, 2.6, 140, 0.0, 1170.4),
    "Cs": (55, 132.91, 0.79, 244, 45.5, 375.7),
    "Ba": (56, 137.33, 0.89, 215, 13.9, 502.9),
    "La": (57, 138.91, 1.1, 207, 48.0, 538.1),
    "Ce": (58, 140.12, 1.12, 204, 50.0, 534.4),
    "Pr": (59, 140.91, 1.13, 203, 50.0, 527.0),
    "Nd": (60, 144.24, 1.14, 201, 50.0, 533.1),
    "Sm": (62, 150.36, 1.17, 198, 50.0, 544.5),
    "Eu": (63, 151.96, 1.2, 198, 50.0, 547.1),
    "Gd": (64, 157.25, 1.2, 196, 50.0, 593.4),
    "Tb": (65, 158.93, 1.2, 194, 50.0, 565.8),
    "Dy": (66, 162.5, 1.22, 192, 50.0, 573.0),
    "Ho": (67, 164.93, 1.23, 192, 50.0, 581.0),
    "Er": (68, 167.26, 1.24, 189, 50.0, 589.3),
    "Tm": (69, 168.93, 1.25, 190, 50.0, 596.7),
    "Yb": (70, 173.05, 1.1, 187, 50.0, 603.4),
    "Lu": (71, 174.97, 1.27, 187, 50.0, 523.5),
    "Hf": (72, 178.49, 1.3, 175, 0.0, 658.5),
    "Ta": (73, 180.95, 1.5, 170, 31.0, 761.0),
    "W": (74, 183.84, 2.36, 162, 78.6, 770.0),
    "Re": (75, 186.21, 1.9, 151, 14.5, 760.0),
    "Os": (76, 190.23, 2.2, 144, 106.1, 840.0),
    "Ir": (77, 192.22, 2.2, 141, 151.0, 880.0),
    "Pt": (78, 195.08, 2.28, 136, 205.3, 870.0),
    "Au": (79, 196.97, 2.54, 136, 222.8, 890.1),
    "Hg": (80, 200.59, 2.0, 132, 0.0, 1007.1),
    "Tl": (81, 204.38, 1.62, 145, 19.2, 589.4),
    "Pb": (82, 207.2, 2.33, 146, 35.1, 715.6),
    "Bi": (83, 208.98, 2.02, 148, 91.3, 703.0),
    "Th": (90, 232.04, 1.3, 179, 0.0, 587.0),
    "U": (92, 238.03, 1.38, 196, 0.0, 597.6),
}
D_ELECTRONS = {
    "H": 0, "He": 0, "Li": 0, "Be": 0, "B": 0, "C": 0, "N": 0, "O": 0, "F": 0, "Ne": 0, "Na": 0, "Mg": 0, "Al": 0, "Si": 0, "P": 0, "S": 0, "Cl": 0,
    "Ar": 0, "K": 0, "Ca": 0, "Sc": 1, "Ti": 2, "V": 3, "Cr": 5, "Mn": 5, "Fe": 6, "Co": 7, "Ni": 8, "Cu": 10, "Zn": 10, "Ga": 0, "Ge": 0, "As": 0,
    "Se": 0, "Br": 0, "Kr": 0, "Rb": 0, "Sr": 0, "Y": 1, "Zr": 2, "Nb": 4, "Mo": 5, "Ru": 7, "Rh": 8, "Pd": 10, "Ag": 10, "Cd": 10, "In": 0,
    "Sn": 0, "Sb": 0, "Te": 0, "I": 0, "Xe": 0, "Cs": 0, "Ba": 0, "La": 1, "Ce": 1, "Pr": 0, "Nd": 0, "Sm": 0, "Eu": 0, "Gd": 1, "Tb": 0, "Dy": 0,
    "Ho": 0, "Er": 0, "Tm": 0, "Yb": 0, "Lu": 1, "Hf": 2, "Ta": 3, "W": 4, "Re": 5, "Os": 6, "Ir": 7, "Pt": 9, "Au": 10, "Hg": 10, "Tl": 0, "Pb": 0,
    "Bi": 0, "Th": 2, "U": 1,
}
VALENCE_ELECTRONS = {
    "H": 1, "He": 2, "Li": 1, "Be": 2, "B": 3, "C": 4, "N": 5, "O": 6, "F": 7, "Ne": 8, "Na": 1, "Mg": 2, "Al": 3, "Si": 4, "P": 5, "S": 6, "Cl": 7,
    "Ar": 8, "K": 1, "Ca": 2, "Sc": 3, "Ti": 4, "V": 5, "Cr": 6, "Mn": 7, "Fe": 8, "Co": 9, "Ni": 10, "Cu": 11, "Zn": 12, "Ga": 3, "Ge": 4, "As": 5,
    "Se": 6, "Br": 7, "Kr": 8, "Rb": 1, "Sr": 2, "Y": 3, "Zr": 4, "Nb": 5, "Mo": 6, "Ru": 8, "Rh": 9, "Pd": 10, "Ag": 11, "Cd": 12, "In": 3,
    "Sn": 4, "Sb": 5, "Te": 6, "I": 7, "Xe": 8, "Cs": 1, "Ba": 2, "La": 3, "Ce": 4, "Pr": 5, "Nd": 6, "Sm": 8, "Eu": 9, "Gd": 10, "Tb": 11,
    "Dy": 12, "Ho": 13, "Er": 14, "Tm": 15, "Yb": 16, "Lu": 3, "Hf": 4, "Ta": 5, "W": 6, "Re": 7, "Os": 8, "Ir": 9, "Pt": 10, "Au": 11, "Hg": 12,
    "Tl": 3, "Pb": 4, "Bi": 5, "Th": 4, "U": 6,
}
OXIDATION_STATE = {
    "H": 1, "He": 0, "Li": 1, "Be": 2, "B": 3, "C": 4, "N": -3, "O": -2, "F": -1, "Ne": 0, "Na": 1, "Mg": 2, "Al": 3, "Si": 4, "P": 5, "S": -2,
    "Cl": -1, "Ar": 0, "K": 1, "Ca": 2, "Sc": 3, "Ti": 4, "V": 5, "Cr": 3, "Mn": 4, "Fe": 3, "Co": 2, "Ni": 2, "Cu": 2, "Zn": 2, "Ga": 3, "Ge": 4,
    "As": 3, "Se": 4, "Br": -1, "Kr": 0, "Rb": 1, "Sr": 2, "Y": 3, "Zr": 4, "Nb": 5, "Mo": 6, "Ru": 4, "Rh": 3, "Pd": 2, "Ag": 1, "Cd": 2, "In": 3,
    "Sn": 4, "Sb": 3, "Te": 4, "I": -1, "Xe": 0, "Cs": 1, "Ba": 2, "La": 3, "Ce": 4, "Pr": 3, "Nd": 3, "Sm": 3, "Eu": 3, "Gd": 3, "Tb": 3, "Dy": 3,
    "Ho": 3, "Er": 3, "Tm": 3, "Yb": 3, "Lu": 3, "Hf": 4, "Ta": 5, "W": 6, "Re": 7, "Os": 4, "Ir": 4, "Pt": 4, "Au": 3, "Hg": 2, "Tl": 3, "Pb": 2,
    "Bi": 3, "Th": 4, "U": 6,
}
WORK_FUNCTION = {
    "H": 0.0, "He": 0.0, "Li": 2.93, "Be": 4.98, "B": 4.45, "C": 5.0, "N": 0.0, "O": 0.0, "F": 0.0, "Ne": 0.0, "Na": 2.36, "Mg": 3.66, "Al": 4.28,
    "Si": 4.85, "P": 0.0, "S": 0.0, "Cl": 0.0, "Ar": 0.0, "K": 2.29, "Ca": 2.87, "Sc": 3.5, "Ti": 4.33, "V": 4.3, "Cr": 4.5, "Mn": 4.1, "Fe": 4.5,
    "Co": 5.0, "Ni": 5.15, "Cu": 4.65, "Zn": 4.33, "Ga": 4.32, "Ge": 5.0, "As": 3.75, "Se": 5.9, "Br": 0.0, "Kr": 0.0, "Rb": 2.26, "Sr": 2.59,
    "Y": 3.1, "Zr": 4.05, "Nb": 4.3, "Mo": 4.6, "Ru": 4.71, "Rh": 4.98, "Pd": 5.12, "Ag": 4.26, "Cd": 4.22, "In": 4.12, "Sn": 4.42, "Sb": 4.55,
    "Te": 4.95, "I": 0.0, "Xe": 0.0, "Cs": 2.14, "Ba": 2.52, "La": 3.5, "Ce": 2.9, "Pr": 2.96, "Nd": 3.2, "Sm": 2.7, "Eu": 2.5, "Gd": 3.1,
    "Tb": 3.0, "Dy": 3.25, "Ho": 3.22, "Er": 3.25, "Tm": 3.25, "Yb": 2.6, "Lu": 3.3, "Hf": 3.9, "Ta": 4.25, "W": 4.55, "Re": 4.72, "Os": 4.83,
    "Ir": 5.27, "Pt": 5.65, "Au": 5.1, "Hg": 4.49, "Tl": 3.84, "Pb": 4.25, "Bi": 4.22, "Th": 3.4, "U": 3.63,
}
IONIC_RADIUS = {
    "H": 0, "He": 0, "Li": 76, "Be": 45, "B": 27, "C": 16, "N": 0, "O": 140, "F": 133, "Ne": 0, "Na": 102, "Mg": 72, "Al": 54, "Si": 40, "P": 38,
    "S": 0, "Cl": 0, "Ar": 0, "K": 138, "Ca": 100, "Sc": 75, "Ti": 61, "V": 54, "Cr": 62, "Mn": 53, "Fe": 65, "Co": 75, "Ni": 69, "Cu": 73,
    "Zn": 74, "Ga": 62, "Ge": 53, "As": 58, "Se": 50, "Br": 0, "Kr": 0, "Rb": 152, "Sr": 118, "Y": 90, "Zr": 72, "Nb": 64, "Mo": 59, "Ru": 62,
    "Rh": 67, "Pd": 86, "Ag": 115, "Cd": 95, "In": 80, "Sn": 69, "Sb": 76, "Te": 97, "I": 0, "Xe": 0, "Cs": 167, "Ba": 135, "La": 103, "Ce": 87,
    "Pr": 99, "Nd": 98, "Sm": 96, "Eu": 95, "Gd": 94, "Tb": 92, "Dy": 91, "Ho": 90, "Er": 89, "Tm": 88, "Yb": 87, "Lu": 86, "Hf": 71, "Ta": 64,
    "W": 60, "Re": 53, "Os": 63, "Ir": 63, "Pt": 63, "Au": 85, "Hg": 102, "Tl": 89, "Pb": 119, "Bi": 103, "Th": 94, "U": 89,
}
POLARIZABILITY = {
    "H": 0.667, "He": 0.205, "Li": 24.3, "Be": 5.6, "B": 3.03, "C": 1.76, "N": 1.1, "O": 0.802, "F": 0.557, "Ne": 0.396, "Na": 23.6, "Mg": 10.6,
    "Al": 6.8, "Si": 5.38, "P": 3.63, "S": 2.9, "Cl": 2.18, "Ar": 1.64, "K": 43.4, "Ca": 22.8, "Sc": 17.8, "Ti": 14.6, "V": 12.4, "Cr": 11.6,
    "Mn": 9.4, "Fe": 8.4, "Co": 7.5, "Ni": 6.8, "Cu": 6.2, "Zn": 5.75, "Ga": 8.12, "Ge": 6.07, "As": 4.31, "Se": 3.77, "Br": 3.05, "Kr": 2.48,
    "Rb": 47.3, "Sr": 27.6, "Y": 22.7, "Zr": 17.9, "Nb": 15.7, "Mo": 12.8, "Ru": 9.6, "Rh": 8.6, "Pd": 4.8, "Ag": 7.2, "Cd": 7.4, "In": 10.2,
    "Sn": 7.7, "Sb": 6.6, "Te": 5.5, "I": 5.35, "Xe": 4.04, "Cs": 59.6, "Ba": 39.7, "La": 31.1, "Ce": 29.6, "Pr": 28.2, "Nd": 31.4, "Sm": 28.8,
    "Eu": 27.7, "Gd": 23.5, "Tb": 25.5, "Dy": 24.5, "Ho": 23.6, "Er": 22.7, "Tm": 21.8, "Yb": 21.0, "Lu": 21.9, "Hf": 16.2, "Ta": 13.1, "W": 11.1,
    "Re": 9.7, "Os": 8.5, "Ir": 7.6, "Pt": 6.5, "Au": 5.8, "Hg": 5.0, "Tl": 7.6, "Pb": 6.8, "Bi": 7.4, "Th": 32.1, "U": 27.4,
}
MELTING_POINT = {
    "H": 14, "He": 1, "Li": 454, "Be": 1560, "B": 2349, "C": 3823, "N": 63, "O": 54, "F": 53, "Ne": 25, "Na": 371, "Mg": 923, "Al": 933, "Si": 1687,
    "P": 317, "S": 388, "Cl": 172, "Ar": 84, "K": 337, "Ca": 1115, "Sc": 1814, "Ti": 1941, "V": 2183, "Cr": 2180, "Mn": 1519, "Fe": 1811,
    "Co": 1768, "Ni": 1728, "Cu": 1358, "Zn": 693, "Ga": 303, "Ge": 1211, "As": 1090, "Se": 494, "Br": 266, "Kr": 116, "Rb": 312, "Sr": 1050,
    "Y": 1799, "Zr": 2128, "Nb": 2750, "Mo": 2896, "Ru": 2607, "Rh": 2237, "Pd": 1828, "Ag": 1235, "Cd": 594, "In": 430, "Sn": 505, "Sb": 904,
    "Te": 723, "I": 387, "Xe": 161, "Cs": 302, "Ba": 1000, "La": 1193, "Ce": 1068, "Pr": 1204, "Nd": 1297, "Sm": 1345, "Eu": 1099, "Gd": 1585,
    "Tb": 1629, "Dy": 1680, "Ho": 1734, "Er": 1802, "Tm": 1818, "Yb": 1097, "Lu": 1925, "Hf": 2506, "Ta": 3290, "W": 3695, "Re": 3459, "Os": 3306,
    "Ir": 2719, "Pt": 2041, "Au": 1337, "Hg": 234, "Tl": 577, "Pb": 601, "Bi": 544, "Th": 2023, "U": 1405,
}
OXIDE_FORMATION_ENTHALPY = {
    "H": -143, "He": 0, "Li": -596, "Be": -609, "B": -410, "C": -394, "N": 0, "O": 0, "F": 0, "Ne": 0, "Na": -414, "Mg": -602, "Al": -559,
    "Si": -456, "P": -299, "S": -297, "Cl": 0, "Ar": 0, "K": -363, "Ca": -635, "Sc": -636, "Ti": -472, "V": -310, "Cr": -380, "Mn": -385,
    "Fe": -275, "Co": -238, "Ni": -240, "Cu": -157, "Zn": -351, "Ga": -363, "Ge": -290, "As": -310, "Se": -172, "Br": 0, "Kr": 0, "Rb": -339,
    "Sr": -592, "Y": -635, "Zr": -551, "Nb": -380, "Mo": -248, "Ru": -153, "Rh": -114, "Pd": -85, "Ag": -31, "Cd": -258, "In": -309, "Sn": -291,
    "Sb": -253, "Te": -161, "I": 0, "Xe": 0, "Cs": -346, "Ba": -554, "La": -598, "Ce": -545, "Pr": -603, "Nd": -603, "Sm": -608, "Eu": -550,
    "Gd": -607, "Tb": -622, "Dy": -621, "Ho": -627, "Er": -633, "Tm": -630, "Yb": -605, "Lu": -626, "Hf": -573, "Ta": -409, "W": -281, "Re": -177,
    "Os": -99, "Ir": -137, "Pt": -67, "Au": 27, "Hg": -91, "Tl": -130, "Pb": -219, "Bi": -191, "Th": -614, "U": -543,
}
TRANSITION_METALS = "Sc Ti V Cr Mn Fe Co Ni Cu Zn Y Zr Nb Mo Ru Rh Pd Ag Cd Hf Ta W Re Os Ir Pt Au Hg".split()
NOBLE_METALS = "Ru Rh Pd Ag Os Ir Pt Au".split()
RARE_EARTHS = "Sc Y La Ce Pr Nd Sm Eu Gd Tb Dy Ho Er Tm Yb Lu".split()


def _columns(*tables: dict) -> dict[str, tuple]:
    """element -> its value in each table; 0 where a table lacks it."""
    return {e: tuple(t.get(e, 0) for t in tables) for e in ELEMENTS}


def _of(name: str) -> dict:
    return {e: v[PROPERTIES.index(name)] for e, v in ELEMENTS.items()}


#: Of each set of formula features, the table and further arguments of its function.
TABLES: dict[str, tuple[dict, tuple]] = {
    "magpie_properties": (ELEMENTS, (PROPERTIES,)),
    "electronic": (_columns(D_ELECTRONS, VALENCE_ELECTRONS, OXIDATION_STATE, WORK_FUNCTION), ()),
    "bonding": (_columns(_of("electronegativity"), IONIC_RADIUS, POLARIZABILITY), ()),
    "thermodynamic": (_columns(MELTING_POINT, OXIDE_FORMATION_ENTHALPY, _of("atomic_mass")), ()),
    "classification": (_columns(D_ELECTRONS, _of("electronegativity"), _of("electron_affinity")), (TRANSITION_METALS, NOBLE_METALS, RARE_EARTHS)),
}
