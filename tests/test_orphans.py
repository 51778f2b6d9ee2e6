import datetime as dt
import random

from tessera.operators import orphans as O

CH = "chunk_id string, symbol_id string, commit_hash string, state string"
SY = "id string, name string, fqname string, repo_id string, file_path string, container_id string, calls array<string>, commit_hash string, live long"
CO = "commit_hash string, committed_at timestamp"
EX = "name string"
FC = "seq long, op string, path string"


def t(n):
    return dt.datetime(2025, 1 + n % 12, 1 + n // 12 % 28, tzinfo=dt.timezone.utc).replace(tzinfo=None)


def make(seed, n=60):
    r = random.Random(seed)
    ids = [f"s{i}" for i in range(12)]
    commits = [(f"c{i}", t(r.randrange(300))) for i in range(15)]
    ch = [(f"k{r.randrange(40)}", r.choice([None, "", " ", "nope", *ids]), r.choice([None, "c99", *[c[0] for c in commits]]), "x") for _ in range(n)]
    sy = []
    for i in ids[:9]:
        row = (i, f"n{r.randrange(5)}", f"f.{i}", r.choice(["r1", "r2"]), f"p{r.randrange(4)}", r.choice([None, " ", "nope", *ids]), r.choice([None, [], [r.choice(["n1", "ext", "", None, "f.s2", "zz"]) for _ in range(3)]]))
        sy += [(*row, r.choice(commits)[0], 1) for _ in range(r.randrange(1, 4))]
    fc = [(r.randrange(50), r.choice(["added", "deleted", "modified"]), f"p{r.randrange(4)}") for _ in range(12)]
    fc = list({x[0]: x for x in fc}.values())
    return ch, sy, commits, [("ext",)], fc


def brute(ch, sy, co, ex, fc):
    when, ext = dict(co), {e[0] for e in ex}
    last = {}
    for s, op, p in sorted(fc):
        last[p] = op
    gone = {p for p, op in last.items() if op == "deleted"}
    blank = lambda x: x is None or not x.strip()
    early = lambda ts: min((x for x in ts if x is not None), default=None)
    refs = {}
    for k, s, c, _ in ch:
        if not blank(s):
            refs.setdefault(("chunks", k, s, None), []).append(when.get(c))
    time = {}
    for row in sy:
        time.setdefault(row[0], []).append(when.get(row[7]))
    for row in sy:
        if not blank(row[5]):
            refs[("symbols", row[0], row[5], None)] = time[row[0]]
        for c in row[6] or []:
            if not blank(c) and c not in ext:
                refs[("calls", row[0], c, row[3])] = time[row[0]]
    out = set()
    for (table, rec, ref, repo), ts in refs.items():
        rows = [x for x in sy if (x[0] == ref if repo is None else x[3] == repo and ref in (x[1], x[2]))]
        at, alive = early(ts), [x for x in rows if x[4] not in gone]
        born = early([when.get(x[7]) for x in alive])
        state = "absent" if not rows else "deleted" if not alive else "late" if at and born and born > at else None
        if state:
            out.add((table, at and at.strftime("%Y-%m"), rec, ref, state))
    return out


def frames(spark, data):
    return [spark.createDataFrame(d, s) for d, s in zip(data, (CH, SY, CO, EX, FC))]


def test_against_brute_force(spark):
    for seed in range(4):
        data = make(seed)
        rows = [tuple(r) for r in O.orphan_report(*frames(spark, data)).collect()]
        assert set(rows) == brute(*data) and len(rows) == len(set(rows))


def test_counts_continue_from_a_state(spark):
    data = make(7)
    ch, sy, co, ex, fc = frames(spark, data)
    whole = {tuple(r) for r in O.key_counts(ch, sy, co, ex, fc).collect()}
    refs = O.references(ch, sy, co, ex)
    first = O.apply_deltas(None, O.reference_deltas(refs), O.KEY)
    both = O.apply_deltas(first, O.existence_deltas(O.existing(sy, co), O.removed_files(fc)), O.KEY)
    assert {tuple(r) for r in O.key_totals(both, O.KEY).collect()} == whole
    assert O.apply_deltas(first, O.reference_deltas(refs, -1), O.KEY).count() == 0


def test_batches_with_removals_equal_one_pass(spark):
    for seed in range(3):
        data = make(seed + 20)
        for upto in (-1, 25, 60):
            rows = [tuple(r) for r in O.report_in_batches(*frames(spark, data), upto_seq=upto).collect()]
            assert set(rows) == brute(*data) and len(rows) == len(set(rows))


def test_the_removal_of_the_earliest_row_moves_the_time(spark):
    """Rows born at 10 and 90, a reference at 50: in time until the first row is removed, late after that, in time when it comes back."""
    sy = [("a", "n", "f", "r", "p1", None, None, "c10", 1), ("a", "n", "f", "r", "p2", None, None, "c90", 1)]
    co, ch = [("c10", t(1)), ("c50", t(5)), ("c90", t(9))], [("k", "a", "c50", "x")]
    for fc, want in (([], set()), ([(1, "deleted", "p1")], {"late"}), ([(1, "deleted", "p1"), (2, "added", "p1")], set()), ([(1, "deleted", "p1"), (2, "deleted", "p2")], {"deleted"})):
        for upto in (0, 1):
            got = O.report_in_batches(*frames(spark, (ch, sy, co, [], fc)), upto_seq=upto).collect()
            assert {r.state for r in got} == want, (fc, upto)


def test_empty(spark):
    assert O.orphan_report(*frames(spark, ([], [], [], [], []))).count() == 0
