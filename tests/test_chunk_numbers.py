"""Chunks are packed once, and their batches hold what the rows held."""

from lectern.operators import chunking as ch


def test_chunks_are_packed_once(spark):
    """numbers of segments and the chunks themselves each packed all units."""
    seen = spark.sparkContext.accumulator(0)
    packed = spark.createDataFrame([("m", 1, 0), ("m", 1, 1), ("m", 2, 0), ("n", 1, 0)], "material_id string, segment long, part long")

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = ch.number_chunks(packed.mapInArrow(look, packed.schema)).collect()
    assert sorted((r.material_id, r.segment, r.part, r.chunk_index) for r in rows) == [("m", 1, 0, 1), ("m", 1, 1, 2), ("m", 2, 0, 3), ("n", 1, 0, 1)]
    assert seen.value == 4


def test_each_unit_is_counted_once():
    asked = []

    def count(text):
        asked.append(text)
        return ch.count_tokens(text)

    packer = ch._Packer(100, 200, 3, count, False)
    for k in range(3):
        assert not list(packer.add(f"some words {k}", 1, k, None))
    assert len(asked) == 3
