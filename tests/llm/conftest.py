from __future__ import annotations

import re

import pytest

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank and very long texts, repeated rows, and extra columns with operators' names."""
    texts = [None, "", " \n\t", "a", "Token = 'abcdef12'", "x" * 200_000, "y z " * 40_000, "é 😀 日本", "same text of five words here", "same text of five words here"]
    rows = [(i, t, "s", 1, [1], 0.5) for i, t in enumerate(texts)] + [(3, "a", "s", 1, [1], 0.5), (None, "no id at all in this row", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, path string, n_words int, items array<int>, score double")


def words(pattern: str, text: str | None) -> list[str]:
    return re.findall(pattern, (text or "").translate(ASCII_LOWER))
