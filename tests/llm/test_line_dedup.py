import hashlib
import re
from collections import Counter

import pytest

from twinleaf.llm import line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)


def brute(rows, least, min_chars=1):
    seen = Counter(k for t in rows for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, n in seen.items() if n >= least and len(k) >= min_chars}
    out = []
    for t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("options", [{}, {"list_bytes": 0}, {"filter_bytes": 64}, {"min_chars": 8}])
def test_against_brute_force(awkward, options):
    rows = awkward.collect()
    want = sorted((str(r.doc_id), n, d, hashlib.sha256(t.encode()).hexdigest()) for r, (n, d, t) in zip(rows, brute([r.text for r in rows], 10, options.get("min_chars", 1)), strict=True))
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digest(awkward, **options).collect())
    assert got == want
    assert any(d for _, _, d, _ in want)


def test_rewritten_texts_keep_other_columns(clashing):
    out = line_dedup.rewrite(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()


def test_empty_table(nothing):
    assert line_dedup.digest(nothing).collect() == []


def test_min_docs_must_allow_the_filters(awkward):
    with pytest.raises(ValueError):
        line_dedup.apply(awkward, min_docs=1)


def test_bloom_filter_never_forgets():
    import numpy as np

    h = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    small = line_dedup.Bloom(64)
    small.add(h)
    assert small.has(h).all()
    large = line_dedup.Bloom(16 * 500)
    large.add(h)
    assert large.has(h).all() and large.has(h + np.uint64(1)).mean() < 0.1
