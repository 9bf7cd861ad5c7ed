"""What a step holds at once, and how its plan moves tables, at sizes where it matters."""

import tracemalloc

import numpy as np


def test_first_thresholds_of_many_queries_hold_few_scores():
    from assaygrid.llm import topk

    rng = np.random.default_rng(4)
    cand, k = rng.integers(-40, 40, (2048, 16)), 20
    cand[1500:] = cand[0]  # many ties
    ids, n = np.arange(2048), 4096
    queries = np.concatenate([cand[:256], rng.integers(-40, 40, (n - 256, 16))])
    qid = np.arange(n)
    best = topk.Best(n, k)
    tracemalloc.start()
    topk.search(best, queries, qid, ids, cand, 2.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 160e6, most  # all 8 million scores are 200 MB, sorted 600 MB
    for q in (0, 5, 255, 256, 4095):
        s = cand @ queries[q]
        want = sorted(((-s[c], c) for c in ids if c != q))[:k]
        own = best.q == q
        assert sorted(zip(-best.score[own], best.id[own], strict=True)) == want


def test_draws_are_added_up_by_key_and_never_sent_whole(spark):
    from assaygrid.plans.engine import CATALOGUE as C

    from assaygrid.sources.scratch import written

    held = {}
    base = lambda t: f"parquet.`/root/testdata/sf0.001/{t}.parquet`"
    for n in ("blk", "fb"):
        held[n] = written(C.plan(spark, n, base, held), n)
    blk, fb = ({(r.block, r.family) if n == "fb" else r.block: r for r in held[n].collect()} for n in ("blk", "fb"))
    sums = C.plan(spark, "drawn_sums", base, held)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
    import hashlib

    by_k, g = {r.k: r for r in blk.values()}, len(blk)
    families = {f for _, f in fb}
    found = {(r.family, r.r): (r.q, r.c) for r in sums.filter("r < 3").collect()}
    for r in range(3):
        drawn = [by_k[int(hashlib.md5(f"7|{r}|{k}".encode()).hexdigest()[:8], 16) % g] for k in range(g)]
        assert found[None, r] == (sum(b.nq for b in drawn), sum(b.nc for b in drawn))
        for f in families:
            rows = [fb[b.block, f] for b in drawn if (b.block, f) in fb]
            want = (sum(x.q for x in rows), sum(x.c for x in rows))
            assert ((f, r) in found) == bool(rows) and (not rows or np.allclose(found[f, r], want))


def test_registered_pairs_with_nulls_meet_in_no_join_whatever_the_tiles(spark):
    from assaygrid.operators import registration

    rng = np.random.default_rng(8)
    motifs = [(i, rng.normal(size=4 * int(rng.integers(6, 12))).tolist()) for i in range(70)]
    df = spark.createDataFrame(motifs, "node long, embedding array<double>")
    whole = registration.register(df, 5)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    rows = sorted(map(tuple, whole.collect()))
    assert rows and registration._dealt(df, 1)[1] == 35  # two tiles a block
    for how in ({"block": 1}, {"block": 9, "at_once": 2}):
        assert sorted(map(tuple, registration.register(df, 5, **how).collect())) == rows
    plain = sorted(map(tuple, registration.register(df).collect()))
    assert [r[:9] for r in rows] == plain


def test_grid_weights_are_added_up_by_key_and_never_sent_whole(spark):
    import hashlib

    from assaygrid.plans.engine import CATALOGUE as C
    from assaygrid.sources.scratch import written

    held = {}
    base = lambda t: f"parquet.`/root/testdata/sf0.001/{t}.parquet`"
    for n in ("side_blocks", "side_values", "grid_blocks"):
        held[n] = written(C.plan(spark, n, base, held), n)
    sums = C.plan(spark, "weighted", base, held)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
    k = {r.block: r.k for r in held["grid_blocks"].collect()}
    sign = {b: 1 if int(hashlib.md5(f"sign|7|1|{i}".encode()).hexdigest()[:8], 16) % 2 == 0 else -1 for b, i in k.items()}
    want, sides = {}, {}
    for r in held["side_blocks"].collect():
        sides.setdefault(r.block, set()).add(r.side)
    for b, s in sides.items():
        want[tuple(sorted(s))] = want.get(tuple(sorted(s)), 0) + sign[b]
    found = {tuple(r.sides): r.hits for r in sums.filter("kind = 'sign' AND r = 1 AND sides IS NOT NULL").collect()}
    assert found == want


def test_slots_of_motifs_widen_so_that_a_motif_travels_seldom(spark):
    from pyspark.sql import functions as F

    from assaygrid.plans.engine import CATALOGUE as C

    for n, k in ((250, 1), (3000, 12), (20000, 16), (100000, 25)):
        status = spark.range(n).select(F.col("id").alias("node"), F.lit("registrable").alias("status"), F.lit(16).alias("core_bp"))
        assert [r.k for r in C.over("lens", {"motif_status": status}).collect()] == [k]


def test_tables_before_and_after_are_read_once(spark):
    """Sound tables are not gone through again for each thing that could be wrong with them."""
    from assaygrid.operators import validation
    from assaygrid.sources.readers import Refusal

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def table(rows):
        schema = "peak_id long, hit_id long, coefficient double, reconstruction double"
        return spark.createDataFrame(rows, schema).mapInArrow(seen, schema)

    before = [(i, h, 1.0 + i % 3, 1.0) for i in range(90) for h in (1, 2)]
    after = [(i, h if i % 2 else h + 1, x, 0.5) for i, h, x, _ in before]
    out = validation.stability("d", table(before), table(after))
    assert read.value == len(before) + len(after)
    assert (out["n_affected_peaks"], out["n_affected_hits"], out["paired_delta_reconstruction_all"]) == (45, 135, -0.5)
    for rows in ([*after, after[0]], [*after[:-1], (None, 1, 1.0, 0.5)], [*after[:-1], (*after[-1][:3], 0.75)], after[2:], []):
        for pair in ((before, rows), (rows, before)):
            try:
                validation.stability("d", *map(table, pair))
            except Refusal:
                continue
            raise AssertionError(pair[0][-1:])


def test_runs_are_drawn_from_hits_worked_out_once(spark, monkeypatch):
    import assaygrid.plans.engine  # noqa: F401
    from assaygrid.operators import audits

    names = []
    monkeypatch.setattr(audits, "written", lambda df, name, keep=audits.written: names.append(name) or keep(df, name))
    hits, both = audits._runs(spark, "/root/testdata/sf0.001")
    assert names == ["base-hits"]
    run = [audits.C.over(n, {"base_hits": hits}).select("peak") for n in ("before_hits", "after_hits")]
    assert sorted(both.collect()) == sorted(run[0].intersect(run[1]).collect())


def test_hits_are_dealt_by_region_in_parts_that_grow_with_the_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from assaygrid.plans import relations
    from assaygrid.plans.engine import CATALOGUE as C
    from assaygrid.sources.scratch import setting

    sf = "/root/testdata/sf0.001"
    run = lambda n: sorted(map(tuple, C.run(n)(spark, sf).collect()))
    plain = {n: run(n) for n in ("region_family_mass", "region_universe")}
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(relations, "ROWS", 100)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):  # tables of these few rows would be sent whole
        held = [r[1] for r in C.run("hits")(spark, sf).groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 0.9 * rows / 100 and max(held) < 300
    close = lambda a, b: a[:3] == b[:3] and np.allclose(a[3:], b[3:], atol=1e-6)
    dealt = run("region_family_mass")
    assert len(dealt) == len(plain["region_family_mass"]) and all(map(close, dealt, plain["region_family_mass"]))
    assert [r[:8] for r in run("region_universe")] == [r[:8] for r in plain["region_universe"]]


def test_universe_is_worked_out_once(spark):
    """The check that a region's rows agree and the result come from one pass over the hits."""
    from assaygrid.operators import reading

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = "region_id string, chrom string, start long, end long, missingness string, hit_coefficient double"
    rows = [(f"r{i}", "c", i * 100, i * 100 + 50, "used", 0.5 + j) for i in range(40) for j in range(3)]
    found = reading.universe(spark.createDataFrame(rows, schema).mapInArrow(seen, schema), 1000).collect()
    assert sorted((r.region_id, r.block, r.n_used, r.mass) for r in found) == sorted((f"r{i}", f"c:{i // 10}", 3, 4.5) for i in range(40))
    assert read.value == len(rows)
