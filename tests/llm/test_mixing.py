"""Mixing against a row-at-a-time version."""

from bookloom.llm import mixing


def brute(docs, weights):
    have = {}
    for _, s, n in docs:
        have[s] = have.get(s, 0) + n
    usable = {s: (w, m) for s, w, m in weights if w > 0 and m >= 1 and have.get(s)}
    size = min(have[s] * m / w for s, (w, m) in usable.items())
    return {s: int(size * w + 1e-6) for s, (w, m) in usable.items()}, have


def test_budgets_and_copies(spark):
    docs = [(i, "big" if i % 3 else "small", 10 + i % 7) for i in range(900)] + [(1000 + i, "tiny", 5) for i in range(6)]
    weights = [("big", 0.6, 1), ("small", 0.35, 1), ("tiny", 0.05, 4), ("absent", 0.1, 2), ("zero", 0.0, 2)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").repartition(5)
    w = spark.createDataFrame(weights, "source string, target_share double, max_repeats int")
    want, have = brute(docs, weights)
    got: dict = {}
    for r in mixing.mix(sized, w).collect():
        limit = {s: m for s, _, m in weights}[r.source]
        assert 1 <= r.copies <= limit
        got[r.source] = got.get(r.source, 0) + r.copies * r.n_tokens
    assert set(got) == set(want)
    for s, budget in want.items():
        assert abs(got[s] - budget) <= 17, s


def test_prefix_sums_equal_a_plain_sum(spark):
    docs = [(i, "hot" if i % 3 else "cold", i % 11) for i in range(2000)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    rows = mixing.prefix_sums(sized).collect()
    assert len(rows) == 2000
    for source in ("hot", "cold"):
        own = sorted((r for r in rows if r.source == source), key=lambda r: r.prefix)
        assert own[-1].prefix == sum(n for _, s, n in docs if s == source)
        assert sorted(r.prefix - r.n_tokens for r in own)[0] == 0
