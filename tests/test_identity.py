"""Row ids against json.dumps, names of member sets, statuses of refusals."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from assaygrid.functions.identity import candidate_id, decision_id, json_list, json_text, member_names, named, row_id
from assaygrid.operators import design, guards
from assaygrid.sources.readers import Refusal

ODD = ["abc", "", "é", "a\x1fb", "\x7f", 'say "x"', "back\\slash", "tab\tline\nfeed\r\b\f", "日本", "😀 smile", " ", "a|b", None]


def test_json_text_is_that_of_json_dumps(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    assert {r.i: r.j for r in df.select("i", json_text(F.col("t")).alias("j")).collect()} == {i: json.dumps(t) for i, t in enumerate(ODD)}
    got = {r.i: r.c for r in df.select("i", candidate_id(F.col("t"), F.lit("s"), F.lit("1"), F.col("t")).alias("c")).collect()}
    assert got == {i: named("annotation", {"node_id": t, "source": "s", "source_version": "1", "matched_motif_id": t}) for i, t in enumerate(ODD)}


def test_decision_ids_of_rows_are_those_of_lists(spark):
    sets = {1: ["b", "a", "é"], 2: ["a|b", "c"], 3: ["a", "b|c"], 4: ["x"]}
    members = spark.createDataFrame([(c, n) for c, nodes in sets.items() for n in nodes], "component long, node string")
    named_ = member_names(members).withColumn("d", row_id("decision", {"node_ids": F.col("members")}, relationship=F.lit("R"), criterion_id=F.lit("DUPLICATE"), criterion_version=F.lit("2"), schema_version=F.lit("1")))
    assert {r.component: (r.n, r.d) for r in named_.collect()} == {c: (len(nodes), decision_id(nodes, "R", "DUPLICATE", "2")) for c, nodes in sets.items()}
    assert spark.range(1).select(json_list(F.array(F.lit("b"), F.lit('"')))).first()[0] == '["b","\\""]'


def test_names_of_large_sets(spark):
    """A root of digests: the same for any order and partitions, another for another set; only leaves hold members."""
    rng = random.Random(2)
    nodes = [f"n{i}" for i in range(900)]
    shuffled = rng.sample(nodes, len(nodes))
    rows = [(1, n) for n in nodes] + [(2, n) for n in shuffled] + [(3, n) for n in nodes[:-1] + ["other"]] + [(4, "a"), (4, "b")]
    name = lambda k: {r.component: r.members for r in member_names(spark.createDataFrame(rows, "component long, node string").repartition(k, "node"), leaf=16, fan=2).collect()}
    got = name(5)
    assert got == name(2) and got[1] == got[2] != got[3] and got[4] == '["a","b"]'
    tree = json.loads(got[1])
    level = {}
    for n in nodes:
        level.setdefault(int(hashlib.md5(n.encode()).hexdigest()[:15], 16) >> 54, []).append(n)
    level = {k: hashlib.sha256(json.dumps(sorted(v), separators=(",", ":")).encode()).hexdigest() for k, v in level.items()}
    for _ in range(3):
        up = {}
        for k in sorted(level):
            up.setdefault(k >> 2, []).append(level[k])
        level = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in up.items()}
    assert tree == {"members": 900, "root": level[0]}


def test_a_failed_guard_is_told_from_a_refused_table(monkeypatch):
    """The status comes from what was raised, not from the guard that was logged last."""
    assert issubclass(guards.GuardRefusal, Refusal)
    good, bad = guards.Verdict("one", True, ""), guards.Verdict("two", False, "x")
    for found in ([bad, good], [good, bad]):
        try:
            guards.require(found)
        except guards.GuardRefusal as error:
            assert "two: x" in str(error)
    assert design.GuardRefusal is guards.GuardRefusal
