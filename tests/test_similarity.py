"""The threshold test of partial similarity against the definition by windows."""

import random

import pytest

from docweir.functions.similarity import fuzz_partial_ratio, partial_at_least


def _pairs(n):
    rng = random.Random(7)
    out = [("", ""), ("", "ABC"), ("ABC", ""), (None, "A"), ("A", None), ("A", "A"), ("AB", "BA"), ("ABCDEFGHIJ", "ABCDEFGHI")]
    for _ in range(n):
        letters = rng.choice(["AB", "ABCD", "ABCDEFGHIJKLMNOPQ"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 70)))
        if rng.random() < 0.75:
            at = rng.randrange(len(text))
            value = list(text[max(0, at - 3):at + rng.randrange(1, 30)])
            for _ in range(rng.randrange(5)):
                k = rng.randrange(len(value)) if value else 0
                value[k:k + rng.randrange(2)] = [rng.choice(letters)] * rng.randrange(2)
            text = text[rng.randrange(3):]
            value = "".join(value)
        else:
            value = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30)))
        out.append((value, text) if rng.random() < 0.8 else (text, value))
    return out


@pytest.mark.parametrize("threshold", [60, 85, 90, 100])
def test_threshold_test_equals_best_window(spark, threshold):
    df = spark.createDataFrame(_pairs(2500), "a string, b string")
    got = df.select("a", "b", fuzz_partial_ratio(df.a, df.b).alias("s"), partial_at_least(df.a, df.b, threshold).alias("near")).collect()
    wrong = [r for r in got if (None if r.s is None else r.s >= threshold) != r.near]
    assert not wrong, wrong[:3]
    assert sum(bool(r.near) for r in got) > 100


def test_long_texts(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(1 << 20))
    value = text[777_000:777_040]
    spoilt = value[:9] + "Q" + value[10:25] + value[26:]
    far = "".join(rng.choice("0123456789") for _ in range(40))
    df = spark.createDataFrame([(spoilt, text), (far, text), (value[::2], text)], "a string, b string")
    assert [r.near for r in df.select(partial_at_least(df.a, df.b, 90).alias("near")).collect()] == [True, False, False]
