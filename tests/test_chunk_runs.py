"""Runs of units among each other, packed from one shuffle of the texts."""

import random

from lectern.operators import chunking as ch


def test_runs_that_alternate_are_packed_apart(spark):
    """texts were joined with the numbers of their runs and shuffled again."""
    rng = random.Random(9)
    rows = [(m, k, k // 7, rng.choice(["a", "b", None]), rng.choice(["OCR", None]), rng.choice(["TEXT", "TEXT", "TABLE"]), f"word{k}" if k % 5 else " ") for m in ("x", "y", None) for k in range(120)]
    units = spark.createDataFrame(rows, "material_id string, unit_no long, page_number long, node_id string, extraction_method string, content_type string, text string")
    packed = ch.pack_chunks(units, target=6, hard=10, overlap=0)
    assert "Join" not in packed._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for m in ("x", "y", None):
        segment, part, last, held = 0, 0, None, []
        for _, k, _, *alike, text in [r for r in rows if r[0] == m and r[6] != " "]:
            n = ch.count_tokens(text)
            if alike != last:
                segment, part, last, held = segment + 1, 0, alike, []
            if not held or alike[2] == "TABLE" or sum(held) + n > 6:
                want.append([m, segment, part, []])
                part, held = part + 1, []
            held.append(n)
            want[-1][3].append(k)
    got = [[r.material_id, r.segment, r.part, [x.unit for x in r.sources]] for r in packed.collect()]
    order = lambda r: (r[0] or "", r[1], r[2])
    assert sorted(got, key=order) == sorted(want, key=order)
