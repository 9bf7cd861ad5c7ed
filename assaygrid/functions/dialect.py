"""Macros of the plan texts, written once and rendered for Spark SQL or for the checking dialect.

{=name}        a parameter
{hex:x}        first 32 bits of md5(x) as a number: the engine's counter-based random stream, the same for any partitioning
{explode:n}    one row for each of 0 ... n - 1
{len:x}        number of elements of an array; {sha:x} SHA-256 of a text in lowercase hex
{list:x}       all values of x in an array; {each:a} one row for each element of an array
{best:x:k}     x of the row with the greatest list of values k, a mergeable aggregate; x is not null
{components:e} connected components (node, component) of the edges (u, v) in e; Spark takes them as a table made beforehand
{ranked:v}     ranks (grp, delta, n, upto, total) of the counted values (grp, delta, n) in v; likewise made beforehand
{dealt:r}      the relation r, which reads given tables, dealt by its first column so that no task holds very many rows
{cells:t:id}   long form of an array column "embedding": id, i (place), v (double)
"""

from __future__ import annotations

import re

#: Parameters of the registered queries; a caller of ``Catalogue.over`` can give others.
PARAMS = {"replicates": 200, "seed": 7, "least_replicates": 39, "least_valid": 30, "floor_mass": 20, "budget_share": 0.25}
SPARK = {
    "hex": lambda x: f"CAST(conv(substr(md5({x}), 1, 8), 16, 10) AS BIGINT)",
    "explode": lambda n: f"explode(sequence(0, {n} - 1))",
    "len": lambda x: f"size({x})",
    "sha": lambda *x: f"sha2({':'.join(x)}, 256)",
    "list": lambda x: f"collect_list({x})",
    "each": lambda a: f"explode({a})",
    "best": lambda x, k: f"max_by({x}, struct({k}))",
    "components": lambda e: f"{{components_{e}}}",
    "ranked": lambda v: f"{{ranked_{v}}}",
    "dealt": lambda r: f"{{dealt_{r}}}",
    "cells": lambda t, c: f"(SELECT {c}, i, CAST(v AS DOUBLE) AS v FROM {t} LATERAL VIEW posexplode(embedding) x AS i, v)",
}
CHECK = {
    "hex": lambda x: f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)",
    "explode": lambda n: f"unnest(range(0, {n}))",
    "len": lambda x: f"len({x})",
    "sha": lambda *x: f"sha256({':'.join(x)})",
    "list": lambda x: f"list({x})",
    "each": lambda a: f"unnest({a})",
    "best": lambda x, k: f"arg_max({x}, row({k}))",
    "components": lambda e: f"(WITH RECURSIVE b AS (SELECT u, v FROM {e} UNION SELECT v, u FROM {e}), reach(node, other) AS (SELECT u, u FROM b UNION SELECT r.node, b.v FROM reach r JOIN b ON b.u = r.other) SELECT node, min(other) AS component FROM reach GROUP BY node)",
    "ranked": lambda v: f"(SELECT grp, delta, n, sum(n) OVER (PARTITION BY grp ORDER BY delta) AS upto, sum(n) OVER (PARTITION BY grp) AS total FROM {v})",
    "dealt": lambda r: r,
    "cells": lambda t, c: f"(SELECT {c}, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM {t})",
}


def render(text: str, macros: dict, params: dict | None = None) -> str:
    """Parameters first ({=name}), then macros."""
    text = re.sub(r"\{=(\w+)\}", lambda m: str({**PARAMS, **(params or {})}[m[1]]), text)
    return re.sub(r"\{(\w+):([^{}]*)\}", lambda m: macros[m[1]](*m[2].split(":")), text)
