"""What classification knows of aircraft types, callsigns and operators. They must equal the published rules."""

#: Longest plausible flight in minutes by type.
ENDURANCE_MIN = {
    "B407": 180, "B429": 180, "EC30": 180, "EC35": 180, "EC45": 180, "S76": 210, "S92": 300, "H60": 180,
    "C150": 240, "C172": 240, "C182": 300, "C208": 420, "PC12": 420, "TBM9": 360,
    "GLF5": 780, "GLF6": 900, "GLF4": 660, "CL60": 540, "C56X": 360, "E55P": 360, "FA7X": 720,
    "K35R": 720, "K35E": 720, "KC10": 840, "KC30": 900, "KC46": 780, "C17": 720, "C5M": 900, "C130": 600, "P8": 600, "E3TF": 660, "E6": 900,
}

#: Service ceilings in feet by type.
CEILING_FT = {
    "B748": 43_100, "B407": 18_500, "S92": 15_000, "S76": 15_000, "H60": 19_000, "UH60": 19_000, "EC35": 20_000, "EC45": 20_000,
    "GLF6": 51_000, "GLF5": 51_000, "GLF4": 45_000, "CL60": 41_000, "C56X": 45_000, "E55P": 45_000, "FA7X": 51_000, "PC12": 30_000,
    "C172": 14_000, "C182": 18_100, "C208": 25_000, "TBM9": 31_000, "K35R": 50_000, "KC46": 40_100, "C17": 45_000, "C5M": 34_000,
    "C130": 28_000, "E3TF": 42_000, "E6": 42_000, "MIL_FW": 45_000,
}

#: Greatest ground speeds in knots by type.
MAX_GS_KT = {
    "B407": 160, "B429": 170, "EC30": 155, "EC35": 160, "EC45": 160, "S76": 175, "S92": 175, "H60": 200, "UH60": 200,
    "C172": 160, "C182": 180, "C208": 190, "PC12": 320, "TBM9": 330, "GLF6": 590, "GLF5": 590, "GLF4": 560, "CL60": 530,
    "C56X": 480, "E55P": 460, "FA7X": 590, "B748": 590, "K35R": 550, "KC46": 530, "C17": 530, "C5M": 500, "C130": 360,
    "E3TF": 500, "E6": 530, "MIL_FW": 600,
}

HELICOPTERS = (
    "B407", "B429", "B429E", "EC30", "EC35", "EC45", "EC20", "EC25", "EC75", "S76", "S92", "H60", "UH60",
    "A109", "A119", "A139", "A169", "AS50", "AS55", "AS65", "B06", "B06T", "B212", "B412",
)

#: Missions by callsign prefix, in the order they are tried.
CALLSIGN_MISSION = {
    "N911": "ems_hems", "PHM": "offshore", "PHI": "offshore", "ERA": "offshore", "BHI": "offshore", "TWY": "exec_charter",
    "GLF": "exec_charter", "GS5": "exec_charter", "LJ": "exec_charter", "NJE": "exec_charter", "EJA": "exec_charter",
    "QE7": "exec_charter", "A7": "exec_charter", "SCH": "training", "SIK": "training",
}

#: Words of an operator's name that mean offshore work.
OFFSHORE_OPERATORS = (
    "PHI AVIATION", "PHI INC", "PETROLEUM HELICOPTER", "ERA HELICOPTER", "ERA AVIATION", "BRISTOW", "COUGAR HELI",
    "CHC HELI", "OMNI HELI", "ROTORCRAFT LEASING",
)

TRAINERS = ("C150", "C152", "C172", "C162", "PA28", "DA20", "DA40")
NEVER_SURVEY = ("B748", "GLF5", "GLF6", "GLF4", "SJ30", "FA7X", "CL60")

#: How lists show missions and landing types.
MISSION_LABEL = {"ems_hems": "EMS", "offshore": "OFFSH", "exec_charter": "CHRT", "training": "TRAIN", "survey": "SRVY", "pattern": "PATRN", "transport": "XFER", "unknown": ""}
LANDING_LABEL = {"confirmed": "OK", "signal_lost": "SIG LOST", "dropped": "DROP", "uncertain": "UNCERT", "altitude_error": "ALT ERR"}
