"""Rule tables and scalar formulas, as data and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nominal diameter; capacity t/h; longest run m; price of a new metre; of a rebuilt metre; width and height of a pair m.
DN_TABLE = [
    (50, 3.5, 181.0, 74023.0, 96180.0, 0.400, 0.125),
    (65, 8.3, 245.0, 78631.0, 109989.0, 0.430, 0.140),
    (80, 13.2, 327.0, 83530.0, 117582.0, 0.470, 0.160),
    (100, 22.3, 419.0, 89748.0, 133694.0, 0.510, 0.180),
    (125, 40.2, 554.0, 97275.0, 148030.0, 0.600, 0.225),
    (150, 65.1, 696.0, 105507.0, 152295.0, 0.650, 0.250),
    (200, 152.3, 1042.0, 120275.0, 181766.0, 0.880, 0.315),
    (250, 274.9, 1379.0, 135323.0, 202030.0, 1.050, 0.400),
    (300, 437.4, 1718.0, 150022.0, 228707.0, 1.150, 0.450),
    (400, 943.1, 2477.0, 190299.0, 271317.0, 1.370, 0.560),
    (500, 1663.4, 3245.0, 224137.0, 333884.0, 1.670, 0.710),
    (600, 2627.7, 4037.0, 264790.0, 372703.0, 1.850, 0.800),
    (700, 3735.1, 4775.0, 324298.0, 439571.0, 2.050, 0.900),
    (800, 5296.8, 5644.0, 325996.0, 489918.0, 2.250, 1.000),
    (900, 7165.0, 6518.0, 327693.0, 553607.0, 2.450, 1.100),
    (1000, 9391.8, 7419.0, 418777.0, 606679.0, 2.650, 1.200),
    (1200, 15012.8, 9288.0, 428074.0, 825692.0, 3.100, 1.425),
    (1400, 22501.9, 11276.0, 683417.0, 978584.0, 3.450, 1.600),
]
DN_SCHEMA = "dn int, capacity double, max_length double, new_cost double, recon_cost double, pair_width double, pair_height double"

#: Restriction type; may be crossed; clearance m; least crossing angle; cost factor; vertical gap m; extra metres on each side; half width m.
RESTRICTIONS = [
    ("park", False, 1.0, None, None, None, None, 0.0),
    ("social_area", False, 1.0, None, None, None, None, 0.0),
    ("prohibited_site", False, 1.0, None, None, None, None, 0.0),
    ("water", False, 1.0, None, None, None, None, 0.0),
    ("oks", False, 1.0, None, None, None, None, 0.0),
    ("railway", False, 1.5, None, None, None, None, 0.0),
    ("road", True, 1.5, 45.0, 1.60, 0.0, 3.0, 0.0),
    ("tram_tracks", True, 1.5, 45.0, 1.75, 0.0, 3.0, 0.0),
    ("gas_pipeline", True, 2.0, 0.0, 1.25, 0.2, 2.0, 0.2),
    ("power_cable", True, 2.0, 0.0, 1.15, 0.5, 2.0, 0.1),
    ("heat_network", True, 1.0, 0.0, 1.05, 0.5, 2.0, 0.0),
]
RESTRICTION_SCHEMA = "type string, crossable boolean, clearance double, min_angle double, factor double, gap double, extra double, half_width double"
SLACK = 1e-9
DEPTH = 3.0
SLOPE = 0.1
CHAMBER_TIE = 5e6


def _steps(pairs: list[tuple[Column, object]], last: Column) -> Column:
    out = F.when(*pairs[0])
    for p in pairs[1:]:
        out = out.when(*p)
    return out.otherwise(last)


def min_dn(flow: Column, strict: bool = True) -> Column:
    """The smallest diameter that carries a flow; beyond the table an error, or null if not ``strict``.

    The table is 18 fixed rows, so the lookup is one generated CASE and needs no join.
    """
    last = F.raise_error(F.concat(F.lit("no diameter carries a flow of "), flow.cast("string"))).cast("int") if strict else F.lit(None).cast("int")
    return F.when(flow.isNull(), F.lit(None).cast("int")).otherwise(_steps([(flow <= r[1] + SLACK, F.lit(r[0])) for r in DN_TABLE], last))


def by_dn(dn: Column, field: str) -> Column:
    """A diameter's value of the table; an error for one that it doesn't have."""
    k = [c.split()[0] for c in DN_SCHEMA.split(", ")].index(field)
    return F.when(dn.isNull(), F.lit(None).cast("double")).otherwise(_steps([(dn == r[0], F.lit(r[k])) for r in DN_TABLE], F.raise_error(F.concat(F.lit("unknown diameter "), dn.cast("string"))).cast("double")))


def chamber_cost(dn: Column) -> Column:
    """A chamber's price by the largest diameter at it."""
    return F.when(dn <= 200, 3e6).when(dn <= 500, 5e6).when(dn <= 1000, 8e6).otherwise(12e6)


def penalty(flow: Column) -> Column:
    """What an unconnected terminal costs."""
    return F.lit(1e8) + F.lit(5e5) * flow


def score(cost: Column, length: Column) -> Column:
    return F.lit(0.7) * cost / F.lit(25e6) + F.lit(0.3) * length / F.lit(100.0)


def depth_factor(depth: Column) -> Column:
    return F.lit(1.0) + F.lit(0.1) * F.greatest(F.lit(0.0), depth - DEPTH)


def building_clearance(dn: Column) -> Column:
    return F.when(dn < 500, 5.0).when(dn <= 800, 7.0).otherwise(9.0)
