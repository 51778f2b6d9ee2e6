import random

from tessera.operators.relations import Store
from tessera.streaming import watch as W

FILES = "path string, language string, content_hash string, last_indexed timestamp"
SYMS = "id string, file_path string"


def test_fold_is_independent_of_order_and_batches(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["added", "modified", "deleted", "3", "1"]), f"p{r.randrange(6)}.py") for i in range(60)]
    rows += rows[:9]
    want = {}
    for s, op, p in sorted(set(rows)):
        want[p] = (s, op in ("deleted", "3"))
    r.shuffle(rows)
    state = None
    for k in range(0, len(rows), 17):
        state = W.fold(state, spark.createDataFrame(rows[k : k + 17], W.CHANGE))
    assert {x.path: (x.seq, x.deleted) for x in state.collect()} == want
    assert W.fold(state, spark.createDataFrame(rows, W.CHANGE)).exceptAll(state).count() == 0


def test_sticky_deletion(spark):
    c = spark.createDataFrame([(1, "deleted", "a.py"), (2, "added", "a.py"), (None, "added", "b.py"), (3, "added", None)], W.CHANGE)
    assert [(r.path, r.deleted) for r in W.coalesce(c).collect()] == [("a.py", False)]
    assert [(r.path, r.deleted) for r in W.coalesce(c, sticky=True).collect()] == [("a.py", True)]


def test_watch_updates_all_relations_once(spark, tmp_path):
    src, store = tmp_path / "changes", Store(spark, str(tmp_path / "store"))
    made = []

    def build(paths):
        made.append(paths.count())
        return {"files": paths.selectExpr("path", "'python' AS language", "'h' AS content_hash", "CAST(NULL AS TIMESTAMP) AS last_indexed"), "symbols": paths.selectExpr("concat(path, '#1') AS id", "path AS file_path")}

    store.publish(store.stage({"files": spark.createDataFrame([("w/old.py", "python", "h", None)], FILES), "symbols": spark.createDataFrame([("w/old.py#1", "w/old.py")], SYMS)}, "start"))

    def run():
        q = W.watch(spark.readStream.schema(W.CHANGE).parquet(str(src)), store, build, str(tmp_path / "cp"), ["files", "symbols"], root="w", seconds=None)
        q.awaitTermination()
        assert W.status(q)["failure"] is None

    write = lambda rows: spark.createDataFrame(rows, W.CHANGE).coalesce(1).write.mode("append").parquet(str(src))
    write([(1, "added", "w/a.py"), (2, "added", "w/b.py"), (3, "added", "x/c.py"), (4, "added", "w/n.txt"), (5, "deleted", "w/old.py")])
    run()
    assert {r.path for r in store.read("files").collect()} == {"w/a.py", "w/b.py"} and {r.id for r in store.read("symbols").collect()} == {"w/a.py#1", "w/b.py#1"}
    write([(9, "deleted", "w/a.py"), (7, "modified", "w/a.py"), (1, "added", "w/b.py")])
    run()
    assert {r.path for r in store.read("files").collect()} == {"w/b.py"} and {r.id for r in store.read("symbols").collect()} == {"w/b.py#1"}
    write([(8, "added", "w/a.py")])
    run()
    assert {r.path for r in store.read("files").collect()} == {"w/b.py"}


def test_backoff():
    assert W.backoff()[:5] == [25, 50, 100, 200, 250] and sum(W.backoff()) <= 5000


def test_a_batch_rewrites_one_bucket(spark, tmp_path):
    src, store = tmp_path / "changes", Store(spark, str(tmp_path / "store"), buckets=8)
    store.publish(store.stage({"files": spark.createDataFrame([(f"w/{i}.py", "python", "h", None) for i in range(200)], FILES)}, "start"))
    build = lambda paths: {"files": paths.selectExpr("path", "'python' AS language", "'new' AS content_hash", "CAST(NULL AS TIMESTAMP) AS last_indexed")}
    spark.createDataFrame([(1, "modified", "w/7.py")], W.CHANGE).write.parquet(str(src))
    beats = []
    q = W.watch(spark.readStream.schema(W.CHANGE).parquet(str(src)), store, build, str(tmp_path / "cp"), ["files"], seconds=None)
    end = W.serve(q, beats.append, lambda: True)
    assert end["failure"] is None and end["totals"] == {"batches": 1, "rows": 1} and beats
    parts = store._manifest(store.current())["relations"]["files"]["parts"]
    assert len(parts) == 8 and sorted(parts.values()).count("batch-0") == 1
    assert sorted((r.path, r.content_hash) for r in store.read("files").collect()) == sorted((f"w/{i}.py", "new" if i == 7 else "h") for i in range(200))


def test_a_watch_that_is_no_longer_wanted_stops(spark, tmp_path):
    src = tmp_path / "changes"
    spark.createDataFrame([(1, "modified", "w/7.py")], W.CHANGE).write.parquet(str(src))
    store = Store(spark, str(tmp_path / "store"))
    q = W.watch(spark.readStream.schema(W.CHANGE).parquet(str(src)), store, lambda p: {}, str(tmp_path / "cp"), ["files"], seconds=0.1)
    left = iter([True] * 4)
    assert W.serve(q, lambda s: None, lambda: next(left, False))["active"] is False
