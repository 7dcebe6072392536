"""Words of many bytes."""

from __future__ import annotations

import pytest

from vesper.llm import byte_bpe, decontaminate, near_dedup, substring_dedup, toxicity

from .test_operators import _bpe, prose, table


def test_a_word_of_30000_bytes_leaves_the_others_their_features(spark):
    rows = [(0, "abcdefghij" * 3000, "en", "s")]
    rows += [(i, prose(i, 30) + (" worthless idiot" if i % 2 else ""), "en", "s") for i in range(1, 201)]
    labels = spark.createDataFrame([(i, i % 2) for i, *_ in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(table(spark, rows), labels)
    asked = [(i, prose(1000 + i, 30) + (" worthless idiot" if i % 2 else ""), "en", "s") for i in range(40)]
    got = toxicity.score(table(spark, asked), model).collect()
    clean, toxic = ([r["score"] for r in got if r["doc_id"] % 2 == y] for y in (0, 1))
    assert sum(t > c for t in toxic for c in clean) > 0.95 * len(toxic) * len(clean), (clean, toxic)


def thue_morse(letters: int) -> tuple[str, str]:
    """Two words without an equal place whose sums of powers agree for any odd base modulo 2**64, from 1,024 letters on."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(letters))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("letters", [1024, 2048, 4096])
def test_words_of_equal_sums_are_told_apart(spark, letters):
    one, two = thue_morse(letters)
    encoder = byte_bpe.Encoder(*_bpe(), True)
    assert [x.tolist() for x in encoder.all_ids([one, two])] == [encoder.own_ids(x).tolist() for x in (one, two)]
    docs = table(spark, [(1, one, "en", "s"), (2, two, "en", "s"), (3, f"{one} a b c d e", "en", "s"), (4, f"{two} a b c d e", "en", "s")])
    assert [r["component"] for r in near_dedup.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 2, 3, 4]
    filler = prose(1, 8).split()
    item = " ".join([*filler[:4], one, *filler[4:], "what is asked here now"])
    same, other = (f"{prose(5, 40)} {item.replace(one, w)} {prose(6, 40)}" for w in (one, two))
    found = decontaminate.contaminated(table(spark, [(1, same, "en", "s"), (2, other, "en", "s")]), spark.createDataFrame([(7, item)], "item_id int, text string")).collect()
    whole = {r["doc_id"]: r["coverage"] for r in found}
    assert whole[1] == 1 and whole.get(2, 0) < 1
    a, b = ([w] * 60 for w in (one, two))
    assert substring_dedup.passages(table(spark, [(1, " ".join(a), "en", "s"), (2, " ".join(b), "en", "s")])).collect() == []
