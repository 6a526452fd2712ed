import duckdb
import numpy as np
import pytest

from foliowash.operators import boxes as OB
from foliowash.plans import views as V
from foliowash.plans.queries import ORACLES, QUERIES
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert differences(df, connect(sf_dir), ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_box_queries_take_all_boxes(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = lines.where("l_returnflag <> 'R'").count()
    assert QUERIES["hw_semi"](spark, sf_dir).count() + QUERIES["hw_anti"](spark, sf_dir).count() == n
    area = lambda b: b["w"] * b["h"]

    def iou(a, b):
        i = max(0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])) * max(0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
        return i / (area(a) + area(b) - i)

    pages = {}
    for b in V.boxes(spark, sf_dir).where("flag = 'R'").collect():
        pages.setdefault(b["page"], []).append(b)
    want = set()
    for boxes in pages.values():
        kept = []
        for b in sorted(boxes, key=lambda b: (-b["score_pct"], b["id"])):
            if all(iou(b, k) <= 0.45 for k in kept):
                kept.append(b)
        want |= {(b["page"], b["id"]) for b in kept}
    assert {tuple(r) for r in QUERIES["nms_greedy"](spark, sf_dir).collect()} == want


def shuffled_rows(node):
    """Rows that the plan of a collected DataFrame has written to shuffles."""
    inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan"}.get(node.nodeName())
    below = [getattr(node, inner)()] if inner else [node.children().apply(k) for k in range(node.children().size())]
    key = "shuffleRecordsWritten"
    return (node.metrics().apply(key).value() if node.metrics().contains(key) else 0) + sum(map(shuffled_rows, below))


def test_union_coverage_shuffles_boxes_not_pixel_rows(spark, sf_dir):
    df = QUERIES["hw_union_coverage"](spark, sf_dir)
    assert df.collect()
    assert 0 < shuffled_rows(df._jdf.queryExecution().executedPlan()) <= 2 * spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_union_coverage_against_pixels(spark):
    rng = np.random.default_rng(4)
    make = lambda n, p: [(int(rng.integers(2)), f"{p}{k}", *map(int, (*rng.integers(-70, 150, 2), *rng.integers(-2, 60, 2)))) for k in range(n)]
    ocr, hw = make(80, "o"), make(200, "h")
    hw += hw[:20] + [(0, "h", None, 1, 5, 5), (None, "h", 1, 1, 5, 5)]
    ocr += [(0, "o", 1, 1, None, 5), (7, "far", 1, 1, 5, 5)]
    cells = lambda b: {(b[0], x, y) for x in range(b[2], b[2] + b[4]) for y in range(b[3], b[3] + b[5])} if None not in b else set()
    inked = set().union(*map(cells, hw))
    want = {(b[0], b[1], n) for b in ocr if (n := len(cells(b) & inked))}
    df = lambda rows, p: spark.createDataFrame(rows, f"page long, {p}id string, {p}x int, {p}y int, {p}w int, {p}h int")
    got = OB.union_coverage(df(ocr, "o_"), df(hw, "h_")).select("page", "o_id", "covered").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 60


def test_union_coverage_with_repeated_rows(spark, sf_dir, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{sf_dir}/lineitem.parquet' UNION ALL SELECT * FROM '{sf_dir}/lineitem.parquet' WHERE l_orderkey % 3 = 0) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert differences(QUERIES["hw_union_coverage"](spark, str(tmp_path)), con, ORACLES["hw_union_coverage"]) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
