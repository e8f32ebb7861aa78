from __future__ import annotations

import hashlib
import random

from siltstone.operators import dataset


def greedy(groups, caps):
    """The sequential rule: groups in order of (key, rows, rare)."""
    full, out, rest = dict.fromkeys(caps, 0), {}, []
    for key, n, rare in groups:
        split = next((s for s in ("dev", "test") if full[s] < caps[s]), None) if rare else None
        if split:
            full[split] += n
            out[key] = split
        else:
            rest.append((key, n))
    for key, n in rest:
        split = next((s for s in ("train", "dev", "test") if full[s] < caps[s]), None)
        if split:
            full[split] += n
            out[key] = split
    return out


def test_groups_are_dealt_as_by_the_greedy_rule(spark):
    random.seed(1)
    rows = [(i, f"key{random.randint(0, 40)}", f"topic{random.choice('aaabbc')}") for i in range(150)]
    pairs = spark.createDataFrame(rows, "pos int, similarity_key string, inferred_topic string")
    counts = {}
    for i, _, t in rows:
        counts.setdefault(t, [0, i])[0] += 1
    order = sorted(counts, key=lambda t: (counts[t][0], counts[t][1]))
    rare = set(order[: len(order) // 2])
    groups = {}
    for _, k, t in rows:
        g = groups.setdefault(k, [0, False])
        g[0] += 1
        g[1] |= t in rare
    listed = sorted(((k, *g) for k, g in groups.items()), key=lambda g: (hashlib.md5(f"42{g[0]}".encode()).hexdigest(), g[0]))
    got = {r["similarity_key"]: r["split"] for r in dataset.assigned(pairs).collect()}
    assert got == greedy(listed, dataset.CAPS)


def test_the_sample_has_the_exact_size(spark):
    from pyspark.sql import functions as F

    assert dataset.sample(spark.range(7), F.col("id"), 3).count() == 3
    assert dataset.sample(spark.range(7), F.col("id"), 30).count() == 7


def test_only_pairs_with_enough_text_are_valid(spark):
    rows = [("12345678901", "12345678901"), ("1234567890", "12345678901"), ("  123456789  ", "12345678901"), (None, "12345678901")]
    assert dataset.valid_qa(spark.createDataFrame(rows, "question string, answer string")).count() == 1


def test_topics_by_default(spark):
    from pyspark.sql import functions as F

    rows = [(None, None), ("", None), ("General", "my_doc"), ("Rates", "x"), (None, "a_b2c")]
    df = spark.createDataFrame(rows, "section string, doc_id string")
    got = [r[0] for r in df.select(dataset.inferred_topic(F.col("section"), F.col("doc_id"))).collect()]
    assert got == ["General", "General", "My Doc", "Rates", "A B2C"]
