"""Fill-in-the-middle: units and cuts against regular expressions, the way back, odd rows."""

import hashlib
import re

import pytest

pytest.importorskip("millrace.llm")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from millrace.llm import fill_middle as fim  # noqa: E402

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t\n\v\f\r]+\Z|\A[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*"}
TEXT = st.text(alphabet="ab\n \té漢😀<P", max_size=60)


def plainly(text, h, plan=fim.LINES):
    """The same by regular expressions over characters."""
    units = re.findall(UNITS[plan.unit], text)
    assert "".join(units) == text
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in (plan.prefix, plan.suffix, plan.middle)) or h[2] % 100 >= plan.rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < plan.spm:
        return len(units), "spm", len(prefix), len(middle), f"{plan.suffix}{suffix}{plan.prefix}{prefix}{plan.middle}{middle}"
    return len(units), "psm", len(prefix), len(middle), f"{plan.prefix}{prefix}{plan.suffix}{suffix}{plan.middle}{middle}"


@given(TEXT, st.tuples(*[st.integers(0, 2**32 - 1)] * 4), st.sampled_from([fim.LINES, fim.Plan(unit="word", rate=70, spm=20, prefix="<pre>", suffix="<suf>", middle="<mid>")]))
@settings(max_examples=400, deadline=None)
def test_cut_and_back(text, h, plan):
    n, form, before, middle, output = fim.transformed(text.encode(), h, plan)
    assert (n, form, before, middle, output.decode()) == plainly(text, h, plan)
    assert fim.restored_text(output, form, plan).decode() == text


@given(st.integers(1, 2**200 - 1))
@settings(max_examples=100, deadline=None)
def test_ranked_bits(mask):
    places = [k for k in range(mask.bit_length()) if mask >> k & 1]
    assert [fim.ranked(mask, r) for r in range(len(places))] == places


def test_odd_rows(spark):
    long = "a line of words é\n" * 200_000 + "end"
    rows = [(1, None), (2, ""), (3, "one"), (None, "a\nb\nc"), (4, long), (5, "x\n\n\ny"), (5, "x\n\n\ny"), (6, "has <M> in it\nand more"), (7, "\n"), (-8, "a\r\nb")]
    docs = spark.createDataFrame([(i, t, 1, "psm", "o") for i, t in rows], "doc_id long, text string, n int, form string, output string")
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = {r["doc_id"]: r for r in made.collect()}
    for i, t in rows:
        digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h = tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
        assert tuple(got[i])[1:] == plainly(t or "", h)
    back = fim.digests(made).collect()
    assert len(back) == len(rows)
    for i, t in rows:
        assert {r["restored_sha256"] for r in back if r["doc_id"] == i} == {hashlib.sha256((t or "").encode()).hexdigest()}
    assert fim.digests(fim.fill_in_middle(docs.where("false"))).count() == 0
