"""The chunker said over spans of words, for comparison: which words each chunk has, not how to find them."""

import hashlib
import re
from itertools import accumulate

# The section labels.
HEADS = (r"^(Section\s+\d+[A-Z]?[.\-]?\s*[A-Z][^.]*)", r"^(\d+[A-Z]?[.)]\s+[A-Z][^.]{5,60})", r"^(CHAPTER\s+[IVXLC]+[.\s][^\n]*)", r"^(PART\s+[IVXLC]+[.\s][^\n]*)")


def header(text):
    found = (re.match(p, text.strip(), re.I) for p in HEADS)
    return next((m[1].strip()[:80] for m in found if m), None)


def spans(ends, size, overlap):
    """(start, end, number of the unit that closes it) of the chunks of units that end at these words."""
    lo, out = 0, []
    for n, (a, b) in enumerate(zip([0, *ends], ends)):
        if b - lo > size and a > lo:
            out.append((lo, a, n))
            lo = max(lo, a - overlap)
    return [*out, (lo, ends[-1], len(ends) - 1)] if ends and ends[-1] > lo else out


def chunks(text, source, size=375, overlap=38):
    paragraphs = [p.strip() for p in re.split(r"\n{2,}", text) if p.strip()]
    labels = list(accumulate(map(header, paragraphs), lambda before, own: own or before))
    units = [(len(u.split()), label) for p, label in zip(paragraphs, labels) for u in ([p] if len(p.split()) <= size else re.split(r"(?<=[.?!])\s+", p))]
    words = " ".join(paragraphs).split()
    bodies = [(" ".join(words[a:b]), units[n][1] or "", b - a) for a, b, n in spans(list(accumulate(n for n, _ in units)), size, overlap)]
    name = re.sub("[^a-z0-9]", "_", source.lower())[:25]
    kept = [x for x in bodies if len(x[0]) >= 50]
    return [(i, f"{name}_{i:05d}_{hashlib.md5(body.encode()).hexdigest()[:6]}", body, label, n) for i, (body, label, n) in enumerate(kept, 1)]
