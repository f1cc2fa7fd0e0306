import datetime
import re

import pytest
from hypothesis import given, settings, strategies as st

from cratewise.llm import pseudonyms as P
from tests.llm.common import clashing, documents, sample_texts

KEY = b"a key"
VALUES = {"email": ["ann.lee@mail.example.com", "x1@a-b.co"], "card": ["4952935900253052", "4111-1111-1111-1111", "378282246310005", "3782 822463 10005"],
          "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], "ssn": ["123-45-6789"], "ip": ["97.51.17.173", "1.2.3.4"],
          "phone": ["+1 (017) 555-7713", "(212) 555-0100", "415-555-0132"], "date": ["2024-02-29", "31/12/1999", "12/31/1999", "01.02.2003"]}
INVALID = ["4952935900253053", "0000000000000000", "GB83 WEST 1234 5698 7654 32", "000-12-3456", "900-12-3456", "256.1.1.1", "01.2.3.4", "2023-02-29",
           "31/02/2001", "1.2.3", "1.2.3.4.5", "a4952935900253052", "49529359002530521234", "1850-01-01"]


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 5000), st.binary(min_size=1, max_size=16))
def test_feistel_is_a_permutation(size, key):
    size = min(size, 300)
    image = [P.feistel(k, size, key, "t") for k in range(size)]
    assert sorted(image) == list(range(size))
    assert [P.feistel(k, size, key, "t", invert=True) for k in image] == list(range(size))


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in VALUES.items() for v in vs])
def test_format_validity_and_inverse(kind, value):
    fresh = P.pseudonym(kind, value, KEY)
    assert fresh != value and P.pseudonym(kind, fresh, KEY, True) == value
    assert P.pseudonym(kind, value, b"other") != fresh
    if kind != "ip":
        assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", fresh.split("@")[0]))) == \
            re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value.split("@")[0])))
    text, spans = P.replace_values(f"see {value}, and {value}!! end", KEY)
    assert text == f"see {fresh}, and {fresh}!! end" and [s[0] for s in spans] == [kind, kind]
    again, spans = P.replace_values(text, KEY)  # a pseudonym is found as its own kind again
    assert [s[0] for s in spans] == [kind, kind]


@pytest.mark.parametrize("value", INVALID)
def test_invalid_values_stay(value):
    assert P.replace_values(f"a {value} b", KEY) == (f"a {value} b", [])


def test_dates_stay_dates():
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(k * 37) for k in range(1500)]
    image = {P.pseudonym("date", d.isoformat(), KEY) for d in days}
    assert len(image) == len(days) and all(datetime.date.fromisoformat(x) for x in image)


def test_neighbouring_values_and_failures_inside():
    text, spans = P.replace_values("4952935900253053 4952935900253052 1.2.3.4.5 97.51.17.173.", KEY)
    assert [s[0] for s in spans] == ["card", "ip"] and text.startswith("4952935900253053 ")


@pytest.mark.parametrize("shape", [lambda d: d, clashing])
def test_documents(spark, shape):
    texts = [*sample_texts(), "mail ann.lee@mail.example.com", "𝄞 97.51.17.173 and ann.lee@mail.example.com"]
    rows = {r["doc_id"]: r for r in P.pseudonymize(shape(documents(spark, texts)), KEY).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        fresh, spans = (None, []) if t is None else P.replace_values(t, KEY)
        assert (rows[i]["text"], rows[i]["n_private"]) == (fresh, len(spans))
        assert rows[i]["private_spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert rows[len(texts) - 2]["text"].split()[-1] == rows[len(texts) - 1]["text"].split()[-1]
    assert P.pseudonymize(documents(spark, []), KEY).count() == 0
