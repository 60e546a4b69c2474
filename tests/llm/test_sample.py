from tracequarry.llm._sample import lowest_hash


def test_lowest_hash(spark):
    rows = spark.createDataFrame([(i % 5000, "hot" if i % 4 else None) for i in range(20_000)] + [(1, "tiny"), (None, "tiny")], "id long, g string")
    got = lowest_hash(rows, "id", "g", 150).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, set()).add(r.id)
    assert {g: len(x) for g, x in by.items()} == {"hot": 150, None: 150, "tiny": 2} and len(got) == 302
    again = lowest_hash(rows.repartition(5), "id", "g", 150).collect()
    assert {(r.g, r.id) for r in got} == {(r.g, r.id) for r in again}
    wide = {(r.g, r.id) for r in lowest_hash(rows, "id", "g", 300).collect()}
    assert {(r.g, r.id) for r in got} <= wide
    assert lowest_hash(rows.limit(0), "id", "g", 5).count() == 0
