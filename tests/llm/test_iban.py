"""IBANs that other capitals or numbers follow."""

import pytest

from kspec.llm import pii

IBAN_TEXTS = [
    ("IBAN GB82 WEST 1234 5698 7654 32 EUR 50.", ["GB82 WEST 1234 5698 7654 32"]),
    ("IBAN GB82WEST12345698765432 DE89 3704 0044 0532 0130 00 AMOUNT 7", ["GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"]),
    ("iban NO93 8601 1117 947, BE68 5390 0754 7034 BIC", ["NO93 8601 1117 947", "BE68 5390 0754 7034"]),
    ("account MT84 MALT 0110 0001 2345 MTLC AST0 01S", ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"]),
    ("IBAN GB82 WEST 1234 5698 7654 33 EUR 50. GB82WEST12345698765432x", []),
    ("IBAN \U0001f600 DE89370400440532013000", ["DE89370400440532013000"]),
    ("IBAN DE89 3704 0044", []),
]


@pytest.mark.parametrize(("text", "want"), IBAN_TEXTS)
def test_iban_before_more_capitals(spark, text, want):
    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [text[s.start : s.end] for s in row.added if s.kind == "iban"] == want
