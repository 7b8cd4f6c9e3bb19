"""Secrets as a table, against replacing one after the other."""

import random
import re

import pytest

from docweir.operators import privacy


def _plain(text, secrets):
    """Sequential replacement, longer secrets first, that leaves labels alone."""
    if text is None:
        return None
    parts = [text]
    for key, secret in sorted(((k, s) for k, s in secrets if s and len(s) > 6), key=lambda x: (-len(x[1]), x[0])):
        parts = [y for x in parts for y in (re.split(f"({re.escape(secret)})", x) if not isinstance(x, tuple) else [x])]
        parts = [(key,) if x == secret else x for x in parts]
    return "".join(f"<redacted:{x[0]}>" if isinstance(x, tuple) else x for x in parts)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    secrets = [(f"k{n}", "".join(rng.choice("abé") for _ in range(rng.randrange(5, 14)))) for n in range(60)]
    secrets += [("twice", secrets[9][1]), ("k-null", None), ("odd", "redacted"), ("wide", "😀😁😂🤣😃😄😅😆"), ("pattern", "a.*b[c](d)")]
    texts = [None, "", "short", "a.*b[c](d)", "x😀😁😂🤣😃😄😅😆y", "redacted"]
    for _ in range(400):
        parts = [rng.choice(secrets)[1] or "" if rng.random() < 0.5 else "".join(rng.choice("abé ") for _ in range(rng.randrange(12)))
                 for _ in range(rng.randrange(6))]
        texts.append("".join(parts))
    return secrets, texts


@pytest.mark.parametrize("small", [0, 10 ** 6])
def test_table_equals_one_after_the_other(spark, cases, monkeypatch, small):
    monkeypatch.setattr(privacy, "SMALL_SECRETS", small)
    monkeypatch.setattr(privacy, "FILTER_WORDS", 16)    # a full filter only sends more places to the table
    secrets, texts = cases
    df = spark.createDataFrame(list(enumerate(texts)), "n long, line string")
    table = spark.createDataFrame(secrets, "key_id string, secret string")
    got = {r.n: r.line for r in privacy.redact_secrets(df, "line", table).collect()}
    assert got == {n: _plain(t, secrets) for n, t in enumerate(texts)}
    assert privacy.redact_secrets(df, "line", table.limit(0)).count() == len(texts)


def test_plan_does_not_grow_with_the_secrets(spark):
    df = spark.createDataFrame([("token 00099999-secret",)], "line string")
    plans = []
    for n in (10, 100_000):
        out = privacy.redact_secrets(df, "line", {f"k{k}": f"{k:08d}-secret" for k in range(n)})
        plans.append(len(out._jdf.queryExecution().toString()))
    assert abs(plans[0] - plans[1]) < 50 and out.first().line == "token <redacted:k99999>"
