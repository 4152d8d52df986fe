"""Hand-made fleets: a tiny one of edge cases, and one that meets the golden counts."""

import datetime
import random
from itertools import cycle

from readyscope.model import EQUIPMENT_SCHEMA, TARGET_SCHEMA

# Fixed values of the golden fleet
BUSINESS_LINES = [
    "XP SU", "AXA SU", "MR", "MI PET", "US", "CT", "XP WH", "SY", "MI SPECT", "AXA", "XP RF",
]
REGIONS = ["SUL", "RIO DE JANEIRO", "CENTRO", "NORDESTE", "SÃO PAULO", "SÃO PAULO INTERIOR"]
READY, PARTIAL, OFFLINE = "SRS READY", "CONNECTED BUT NOT SRS READY", "NOT CONNECTED"
OK, EXPIRED = "Connection OK", "Connection Expired 30+ days"

_DAY = datetime.date(2024, 3, 15)


def edge_equipment(spark):
    rows = [
        # serial, level, system, name, line, city, state, region, link status, installed
        ("1", READY, "M1", "Model 1", "CT", "Recife", "PE", "NORDESTE", OK, _DAY),
        ("2", READY, "M1", "Model 1", "CT", "Recife", "PE", "NORDESTE", EXPIRED, _DAY),
        ("3", PARTIAL, "M1", "Model 1", "CT", None, "PE", "NORDESTE", OK, _DAY),
        ("4", PARTIAL, "M2", "Model 2", "MR", "Santos", "SP", "SÃO PAULO INTERIOR", None, _DAY),
        ("5", PARTIAL, "M2", "Model 2", "MR", "Santos", None, "SÃO PAULO INTERIOR", EXPIRED, None),
        ("6", OFFLINE, "M2", "Model 2", "MR", "Santos", "SP", "SP INTERIOR", None, _DAY),
        ("7", None, "M3", "Model 3", "MR", "Santos", "SP", "SUL", EXPIRED, _DAY),
        ("8", None, None, None, "CT", "Santos", "SP", None, OK, _DAY),
        ("9", READY, "ZZ", "Unlisted", "CT", "Santos", "SP", "SUL", OK, _DAY),
        ("9", READY, "M2", "Model 2", "CT", "Santos", "SP", "SUL", OK, _DAY),
        (None, OFFLINE, "M2", "Model 2", None, "Santos", "SP", "SUL", EXPIRED, _DAY),
    ]
    return spark.createDataFrame(rows, EQUIPMENT_SCHEMA)


def edge_targets(spark):
    rows = [
        ("M1", "Model One", "MOBILE SYSTEM", 0.25),
        ("M2", "Model Two", "FIXED SYSTEM", 0.87),
        ("M3", "Model Three", "FIXED SYSTEM", 0.87),
        ("M4", "Never installed", "FIXED SYSTEM", 0.87),
        (None, "No material", "FIXED SYSTEM", 0.5),
        (None, "No material", "FIXED SYSTEM", 0.5),
    ]
    return spark.createDataFrame(rows, TARGET_SCHEMA)


def golden_targets(spark):
    rows = [
        (f"MOD{n:03d}", f"MODEL {n}", "MOBILE SYSTEM" if n <= 12 else "FIXED SYSTEM",
         0.25 if n <= 12 else 0.87)
        for n in range(1, 77)
    ]
    return spark.createDataFrame(rows, TARGET_SCHEMA)


def golden_equipment(spark):
    other_regions = [r for r in REGIONS if r != "SÃO PAULO INTERIOR"]
    other_lines = [line for line in BUSINESS_LINES if line != "AXA"]
    inner, outer = [("AXA", "SÃO PAULO INTERIOR")], [("AXA", r) for r in other_regions]
    rest = [(line, region) for region in REGIONS for line in other_lines]
    blocks = [
        # (line, region) in turn, level, link status, rows
        (inner, READY, OK, 38), (inner, PARTIAL, OK, 1),
        (outer, READY, OK, 123), (outer, PARTIAL, EXPIRED, 13), (outer, OFFLINE, None, 8),
        (rest, READY, OK, 1485), (rest, PARTIAL, OK, 67), (rest, PARTIAL, EXPIRED, 148),
        (rest, OFFLINE, None, 403),
    ]
    systems = cycle([*[f"MOD{n:03d}" for n in range(1, 77)], "UNLISTED"])
    rows = []
    for places, level, link, count in blocks:
        for _, (line, region) in zip(range(count), cycle(places)):
            system = next(systems)
            rows.append(
                (str(100001 + len(rows)), level, system, f"NAME {system}", line, "City", "ST",
                 region, link, _DAY)
            )
    return spark.createDataFrame(rows, EQUIPMENT_SCHEMA)


def random_equipment(spark, rows=1500, seed=11):
    """Any combination of values, with nulls in every column and a hot system."""
    rng = random.Random(seed)
    systems = ["MOD007"] * 20 + [f"MOD{n:03d}" for n in range(1, 90)] + [None] * 5

    def pick(*values):
        return rng.choice([*values, None])

    return spark.createDataFrame(
        [
            (
                pick(str(n), "same"),
                pick(READY, READY, PARTIAL, PARTIAL, OFFLINE),
                (system := rng.choice(systems)),
                pick(f"NAME {system}", f"NAME {system}", "OTHER"),
                pick(*BUSINESS_LINES),
                pick("Recife", "Santos"),
                pick("PE", "SP"),
                pick(*REGIONS, "SP INTERIOR"),
                pick(OK, OK, EXPIRED, "Connection Expired", "connection ok", ""),
                pick(_DAY),
            )
            for n in range(rows)
        ],
        EQUIPMENT_SCHEMA,
    )
