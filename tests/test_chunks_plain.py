"""The chunker against a plain reading of its rules, over the pages of the smallest tables."""

import hashlib
import os
import re

import pytest

from docloom.functions.text import BOILERPLATE
from docloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
TARGET, LEAST, RELAXED, UNIT, WINDOW = 1500, 300, 150, 2000, 800


def clean(text):
    out = (text or "").replace("\r", "\n")
    out = re.sub(r"(\w)-\n(\w)", r"\1\2", out).replace("\t", " ")
    out = re.sub("\n{3,}", "\n\n", re.sub(" +", " ", out))
    out = "\n\n".join(part.replace("\n", " ") for part in out.split("\n\n"))
    out = re.sub(r"\bFederal Register\s*/\s*Vol\.\s*\d+.*?Rules and Regulations\b", "", out, flags=re.I)
    out = re.sub(r"\bVerDate\b.*?\bJkt\b|\bE:\\FR\\FM\\b", "", out, flags=re.I)
    out = re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", out))
    return re.sub(r"[\x00-\x1f\x7f-\x9f]", "", out).strip()


def units_of(text):
    out = []
    for sentence in re.split(r"(?<=[.?!])[ \t]+", clean(text)):
        sentence = sentence.strip()
        if len(sentence) <= UNIT:
            out += [sentence] if sentence else []
            continue
        for clause in filter(None, (c.strip() for c in re.split(r"(?<=[;:,)])\s+", sentence))):
            parts = [clause] if len(clause) <= UNIT else [clause[i : i + WINDOW].strip() for i in range(0, len(clause), WINDOW)]
            out += [p for p in parts if p]
    return out


def chunks_of(pages, least):
    """(text, first page, last page) of an attachment's chunks, from the list of all its units."""
    units = [(u, page) for page, text in pages for u in units_of(text)]
    out, begin, end = [], 0, 0

    def chunk():
        text = " ".join(u for u, _ in units[begin:end]).strip()
        if begin == end or len(text) < least or any(b in text.lower() for b in BOILERPLATE):
            return None
        return text, min(p for _, p in units[begin:end]), max(p for _, p in units[begin:end])

    while end < len(units):
        end += 1
        if sum(len(u) + 1 for u, _ in units[begin:end]) >= TARGET and (made := chunk()):
            out.append(made)
            # the next chunk begins with the last unit, and with the one before if both are short
            begin = end - 1
            if begin > 0 and end - begin < 2 and end >= 2 and len(units[end - 1][0]) + len(units[end - 2][0]) <= int(TARGET * 0.2) and end - 2 >= begin_of(out, units, end, made):
                begin = end - 2
    last = chunk()
    return out + ([last] if last else [])


def begin_of(out, units, end, made):
    """Where the units of the chunk just made begin: its text is theirs."""
    begin = end
    while begin > 0 and len(" ".join(u for u, _ in units[begin:end]).strip()) < len(made[0]):
        begin -= 1
    return begin


def test_chunks_equal_a_plain_reading(spark):
    from docloom.plans.text_queries import _clean_pages

    pages = {}
    for r in _clean_pages(spark, SF).collect():
        pages.setdefault((str(r.page_ptr_id), str(r.policydocument_id)), []).append((r.page_num, r.text, r.source_path))
    want = {}
    for (entry, document), rows in pages.items():
        if len({p for _, _, p in rows if p}) > 1:
            continue
        rows = [(n, t) for n, t, _ in sorted(rows, key=lambda x: x[0])]
        for text, first, last in chunks_of(rows, LEAST) or chunks_of(rows, RELAXED):
            digest = hashlib.blake2b(f"pdf|{entry}|{document}|{first}|{last}|{re.sub('[ \t]+', ' ', text).strip()}".encode(), digest_size=8).hexdigest()
            want[f"{entry}_pdf_{document}_p{first:04d}-p{last:04d}_h{digest}"] = (text, first, last)
    got = {r.chunk_id: (r.text, r.page_start, r.page_end) for r in catalog.queries()["pdf_chunks"](spark, SF).collect()}
    assert len(want) > 20 and got == want


def test_all_chunks_have_their_metadata(spark):
    policies = {str(r.page_ptr_id): r for r in spark.read.parquet(f"{SF}/policies.parquet").collect()}
    rows = catalog.queries()["all_chunks"](spark, SF).collect()
    kinds = {r.source_type for r in rows}
    assert kinds == {"pdf_page", "policy_title", "policy_summary"}
    paged = {r.page_ptr_id for r in rows if r.source_type == "pdf_page"}
    assert any(r.page_ptr_id not in paged for r in rows if r.source_type == "policy_title")  # policies without pages keep theirs
    for r in rows:
        known = policies.get(r.page_ptr_id)
        assert (r.policy is None) == (known is None)
        if known is not None:
            assert (r.policy.iptp_id, r.policy.title, r.policy.administration) == (r.page_ptr_id, known.title, known.administration)
        assert (r.attachment is not None) == (r.source_type == "pdf_page")
        if r.source_type == "policy_title":
            digest = hashlib.blake2b(f"ttl|{r.page_ptr_id}|0|{re.sub('[ \t]+', ' ', r.text).strip()}".encode(), digest_size=8).hexdigest()
            assert r.chunk_id == f"{r.page_ptr_id}_ttl_h{digest}"
