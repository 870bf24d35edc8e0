"""Reading order where a page's spreads along both axes are equal but for rounding."""

from __future__ import annotations

import duckdb
import pandas as pd

from tests.compare import plain
from vellum.operators.ordering import coordinate_order
from vellum.queries import ORACLES
from vellum.sources.layout import LINES_SQL

#: Lines (page_id, line_id, x, y, w, h) of pages with equal spreads.
LINES = [
    (1027412, 1, 130, 60, 42, 17), (1027412, 2, 180, 160, 19, 44), (1027412, 3, 45, 185, 23, 13), (1082129, 1, 115, 15, 13, 23),
    (1082129, 2, 75, 55, 24, 14), (1082129, 3, 115, 15, 15, 25), (1139231, 1, 70, 100, 36, 11), (1139231, 2, 40, 50, 11, 21),
    (1139231, 3, 95, 30, 39, 14), (4027412, 1, 130, 60, 42, 17), (4027412, 2, 180, 160, 19, 44), (4027412, 3, 45, 185, 23, 13),
    (4082129, 1, 115, 15, 13, 23), (4082129, 2, 75, 55, 24, 14), (4082129, 3, 115, 15, 15, 25), (4139231, 1, 70, 100, 36, 11),
    (4139231, 2, 40, 50, 11, 21), (4139231, 3, 95, 30, 39, 14),
]


def test_equal_spreads_go_by_the_rounding_of_the_sql(spark):
    boxes = pd.DataFrame(LINES, columns=["page_id", "line_id", "x", "y", "w", "h"])
    con = duckdb.connect()
    con.register("boxes", boxes)
    want = con.execute(ORACLES["W1_coordinate_order"].replace(LINES_SQL, "lines AS (SELECT * FROM boxes)")).df()
    got = coordinate_order(spark.createDataFrame(boxes[::-1]).repartition(3)).select("page_id", "line_id", "place").toPandas()
    assert plain(got) == plain(want)
