"""The engine's queries against SQL, and its readers and matrix operators against hand-made cases."""

import numpy as np
import pytest
from compare import compare

SMALL = "/root/testdata/sf0.001"


def test_queries_equal_their_sql(spark):
    from assaygrid.plans.engine import ORACLES

    assert compare(spark, SMALL, list(ORACLES)) == []


def test_replicates_do_not_depend_on_partitions(spark):
    from assaygrid.plans.engine import QUERIES

    found = []
    for n in ("1", "4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, QUERIES["effect_bootstrap_replicates"](spark, SMALL).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert found[0] == found[1] == found[2]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain_core(x):
    top = [max(abs(v) for v in row) for row in x]
    keep = [p for p, v in enumerate(top) if v >= 0.3 * max(top)]
    return x[keep[0] : keep[-1] + 1]


def plain_ppm(x):
    return [[abs(v) / sum(map(abs, row)) if any(row) else 0.0 for v in row] for row in x]


def plain_best(a, c):
    """(orientation, offset, rows, similarity) of two PPMs, offset by offset; None where none has the overlap."""
    best = None
    for sign, b in (("+", c), ("-", [row[::-1] for row in c[::-1]])):
        for d in range(1 - len(b), len(a)):
            rows = [(a[p], b[p - d]) for p in range(len(a)) if 0 <= p - d < len(b)]
            if len(rows) >= 6 and 2 * len(rows) >= len(a) and 2 * len(rows) >= len(b):
                score = plain_cosine(rows)
                if best is None or score > best[3]:
                    best = (sign, d, len(rows), score)
    return best


def plain_cosine(rows):
    dot, p, q = (sum(x * y for u, v in f for x, y in zip(u, v, strict=True)) for f in (rows, [(u, u) for u, _ in rows], [(v, v) for _, v in rows]))
    return round(dot / (p * q) ** 0.5, 9) if p and q else 0.0


def test_pair_registration_by_plain_loops(spark):
    """Signed matrices of 4 to 20 rows with heavy rows, ties and zeros, against the rule written out pair by pair; and their null."""
    from assaygrid.operators.registration import register, shuffle

    rng = np.random.default_rng(4)
    m = [rng.normal(size=(rng.choice([4, 9, 16, 20]), 4)) * rng.choice([1, 2], size=(1, 1)) for _ in range(9)]
    wide = rng.normal(size=(16, 4))
    wide[:3] *= 0.01
    m += [wide, wide[::-1, ::-1], -wide, np.ones((12, 4)), 2e200 * np.ones((12, 4)), np.zeros((8, 4))]
    x = [plain_core(v.tolist()) for v in m]
    ppm, want = [plain_ppm(v) for v in x], {}
    for s in range(len(m)):
        for t in range(s + 1, len(m)):
            found = plain_best(ppm[s], ppm[t])
            if found:
                sign, d, n, _ = found
                c = x[t] if sign == "+" else [row[::-1] for row in x[t][::-1]]
                scale = lambda v: max(max(map(abs, r)) for r in v) or 1.0
                rows = [([v / scale(x[s]) for v in x[s][p]], [v / scale(x[t]) for v in c[p - d]]) for p in range(len(x[s])) if 0 <= p - d < len(c)]
                null = [plain_best(ppm[s], [ppm[t][i] for i in shuffle(7, k, len(ppm[t]))])[3] for k in range(3)]
                want[s, t] = (*found[:3], n / len(x[s]), n / len(x[t]), found[3], plain_cosine(rows), (sum(v >= found[3] for v in null) + 1) / 4, min(null), max(null))
    odd = [(90, None), (91, []), (92, [1.0] * 6), (93, [1.0, None, 1.0, 1.0]), (94, [float("nan")] * 24), (None, [1.0] * 32)]
    df = spark.createDataFrame([(i, [float(v) for v in a.ravel()]) for i, a in enumerate(m)] + odd, "node long, embedding array<double>")
    assert 30 < len(want) < 105
    for block in (1, 4, 256):
        got = {(r.source, r.target): (r.orientation, r.offset, r.overlap_bp, r.overlap_frac_source, r.overlap_frac_target, r.ppm_similarity, r.signed_cwm_similarity, r.empirical_p_value, r.null_min, r.null_max) for r in register(df, 3, block=block).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][:3] == w[:3] and np.allclose(got[k][3:], w[3:], atol=3e-9) for k, w in want.items()), [(k, got[k], w) for k, w in want.items() if not (got[k][:3] == w[:3] and np.allclose(got[k][3:], w[3:], atol=3e-9))][:4]
    assert want[9, 10][0] == "-" and want[9, 11][6] == -1 and want[9, 11][5] == 1
    assert register(df.filter("node > 89")).count() == 0


def test_a_long_chain_is_one_component(spark):
    from assaygrid.operators.graph import components

    n = 10_000
    rows = components(spark.range(n).selectExpr("id AS u", "id + 1 AS v").unionAll(spark.sql("SELECT 20000L AS u, 20000L AS v UNION ALL SELECT 20001L, NULL")))
    got = rows.groupBy("component").count().collect()
    assert [(r[0], r[1]) for r in got] == [(0, n + 1)]


def test_workers_need_no_path(tmp_path):
    """From another folder, without the repository on the path of Python workers."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from assaygrid.plans.engine import QUERIES
s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()
print('rows', QUERIES['effect_ci_bca'](s, {SMALL!r}).count(), len(QUERIES['effect_ci_bca'](s, {SMALL!r}).collect()))
from assaygrid.operators.registration import register
df = s.createDataFrame([(i, [float(j * i % 7) for j in range(32)]) for i in range(3)], 'node long, embedding array<double>')
print('pairs', len(register(df).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "rows 6 6" in out.stdout and "pairs 3" in out.stdout, out.stderr[-2000:]


def hit(**k):
    row = {"region_id": "r1", "chrom": "c", "start": 1, "end": 2, "variant_id": "v", "family_id": "f", "hit_coefficient": 0.5, "missingness": "used", "input_scale": 1, "lexicon_id": "L", "substrate_id": "s"}
    return row | k


def test_hit_tables(spark, tmp_path):
    from assaygrid.sources.readers import HIT, Refusal, check_hits, read_hits

    rows = [hit(), hit(region_id="r2", family_id=None, variant_id=None, hit_coefficient=None, missingness="not_searched")]
    df = spark.createDataFrame([tuple(r[f.name] for f in HIT) for r in rows], HIT)
    df.write.parquet(str(tmp_path / "h.parquet"))
    text = "\t".join(f.name for f in HIT) + "\n" + "\n".join("\t".join("NA" if r[f.name] is None else str(r[f.name]) for f in HIT) for r in rows)
    (tmp_path / "h.tsv").write_text(text + "\n")
    a, b = read_hits(spark, str(tmp_path / "h.parquet")), read_hits(spark, str(tmp_path / "h.tsv"))
    assert sorted(check_hits(a).collect()) == sorted(check_hits(b).collect()) or set(a.collect()) == set(b.collect())
    with pytest.raises(Refusal, match="missing columns"):
        df.drop("chrom").write.parquet(str(tmp_path / "g.parquet"))
        read_hits(spark, str(tmp_path / "g.parquet"))
    for bad in (hit(hit_coefficient=None), hit(missingness="seen"), hit(start=3), hit(lexicon_id="M")):
        with pytest.raises(Refusal):
            check_hits(spark.createDataFrame([tuple(r[f.name] for f in HIT) for r in [hit(), bad]], HIT))
    with pytest.raises(Refusal, match="empty"):
        check_hits(spark.createDataFrame([], HIT))


def test_region_sets(spark, tmp_path):
    from assaygrid.sources.readers import Refusal, read_regions

    (tmp_path / "r.bed").write_text("# note\ntrack x\nchr1\t5\t9\tp1\nchr2 1 2\n\nid7\nid7\n")
    assert {r.region_id for r in read_regions(spark, str(tmp_path / "r.bed")).collect()} == {"p1", "chr2:1-2", "id7"}
    (tmp_path / "e.bed").write_text("\n")
    with pytest.raises(Refusal):
        read_regions(spark, str(tmp_path / "e.bed"))


@pytest.mark.parametrize("sides", ["FOP", "OP"])
def test_grid_keeps_families_of_one_side(spark, tmp_path, sides):
    """Families on one side, on no side of a contrast, without a used hit, without a row; and a side without regions."""
    from assaygrid.plans.engine import QUERIES

    on = {"F": [("A", 0.1), ("B", 0.1), ("D", 0.0)], "O": [("A", 0.1), ("C", 0.1), ("D", 0.0)], "P": [("E", 0.1)]}
    orders = [(i, "c", side) for i, side in enumerate(sides * 2)]
    lines = [(i, "ABCDEX".index(f), n, 1000.0 * (n + 1) * (1 + (side == "O")), d, "R" if f == "B" else "N") for i, _, side in orders[: len(sides)] for n, (f, d) in enumerate(on[side])]
    lines += [(i, 0, 0, 1000.0, 0.1, "N") for i, _, side in orders[len(sides) :] if side != "P"]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, f, "b") for i, f in enumerate("ABCDEX")], "p_partkey long, p_type string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    side_of = {i: side for i, _, side in orders}
    searched = {side: sum(side_of[i] == side and (side != "P" or any(x[0] == i for x in lines)) for i in side_of) for side in "FOP"}
    in_table = {"ABCDEX"[x[1]] for x in lines}
    states, effects = {}, {}
    for estimand in ("F_vs_O", "O_vs_F", "F_vs_P"):
        q, c = estimand[0], estimand[-1]
        for measure in ("signed", "mass", "count"):
            for f in "ABCDEX":
                own = {side: [x for x in lines if side_of[x[0]] == side and "ABCDEX"[x[1]] == f] for side in (q, c)}
                value = lambda x: {"signed": -1 if x[5] == "R" else 1, "mass": 1}[measure] * x[3] * (1 - x[4]) / 1000 if measure != "count" else 1  # noqa: B023, E731
                used = {side: [value(x) for x in own[side] if x[4] >= 0.02] for side in own}
                effect = None
                if not (searched[q] and searched[c]):
                    state = "CELL_REFUSED"
                elif f not in in_table:
                    state = "NOT_IN_LEXICON"
                elif not (own[q] or own[c]):
                    state = "NOT_SEARCHED"
                elif not (used[q] or used[c]):
                    state = "NOT_ESTIMABLE"
                else:
                    effect = sum(used[q]) / searched[q] - sum(used[c]) / searched[c]
                    state = "ESTIMATED" if abs(effect) > 1e-12 else "MEASURED_ZERO"
                key = (f"{estimand}/{measure}", f)
                states[key], effects[key] = state, effect
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r.cell, r.family): r.state for r in run("family_cell_states")} == states
    got = {(r.cell, r.family): r.effect for r in run("grid_effects")}
    assert got.keys() == effects.keys() and all(got[k] == (v if v is None else pytest.approx(v, abs=1e-8)) for k, v in effects.items())
    by = {}
    for (cell, f), v in effects.items():
        if v is not None:
            by.setdefault((cell.split("/")[0], f), []).append(v)
    assert {(r.estimand, r.family): (r.n_cells, r.n_positive, r.n_negative) for r in run("stability_within_estimand")} == {k: (len(v), sum(x > 1e-12 for x in v), sum(x < -1e-12 for x in v)) for k, v in by.items()}
    status = {r.status: r.n_cells for r in run("cell_status_histogram")}
    assert status == {"SUCCESS": 9 * (sides == "FOP"), "REFUSED_SCHEMA": 9 * (sides != "FOP"), "REFUSED_GUARD": 0, "NOT_ESTIMABLE": 0, "ERROR": 0}
    want = {"ESTIMATED", "MEASURED_ZERO", "NOT_ESTIMABLE", "NOT_SEARCHED", "NOT_IN_LEXICON"} if sides == "FOP" else {"CELL_REFUSED"}
    assert set(states.values()) == want
