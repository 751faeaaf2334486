"""Personal information in free text: spans proposed by generous patterns, chosen by boosted trees.

Generators propose overlapping spans of five kinds. Boosted trees score each by its form and its
context; they are trained on a bounded sample of documents whose labels come from clear cues (the
register of name parts, labels such as a card's name before a number). The threshold of each kind
is calibrated on held-out documents of the sample. Overlaps go to the better score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_sample
from .boost import Trees
from .terms import hash64

#: Documents the trees are trained on, at most.
SAMPLE = 4_000
#: Rounds of training, and the probability from which on a candidate without a label gets one for the next.
ROUNDS, CERTAIN = 3, 0.9
#: Labelled candidates of a kind that its trees need, at least.
LEAST = 40
#: Parts of names that are sent to the executors, at most.
MAX_REGISTER = 200_000

KINDS = ("name", "email", "phone", "id_number", "address")
PLACEHOLDERS = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}

# Forms of address before a name, street types, and words that are no part of a name.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Smt", "Shri", "Sri", "Dr", "Adv", "Kumari", "Prof", "Justice")
STREETS = ("Road", "Street", "Lane", "Avenue", "Bypass", "Cross", "Layout", "Bazaar", "Marg", "Colony", "Nagar", "Main", "Square", "Row", "Extension", "Enclave", "Gali", "Chowk")
NOT_NAMES = frozenset(
    "address contact mobile phone email mail date place witnesses witness flat house door plot block phase from to petitioner respondent her his the and between name names the that this "
    "in on at by for of or if is it no court high district sessions family labour rent consumer revenue land green apex tribunal bench forum board act section whether under pan uid aadhaar passport "
    "january february march april may june july august september october november december registrar kindly please signed dated receipt survey appeal enquiry according deponent advocate yours faithfully "
    "shall was were had has have not nothing every person upon contrary notwithstanding reading what much provided witnesses question model answer".split()
)

_TOK = r"(?:[A-Z][a-z]{2,}|[A-Z]{4,})"
_INI = r"[A-Z]\."
_GAP = r"(?: |\n)"
_NAME = re.compile(rf"(?<![\w@.+-])(?:(?:{'|'.join(TITLES)})\.?{_GAP})*(?:(?:{_INI}{_GAP}?){{1,3}}{_TOK}(?:{_GAP}{_TOK}){{0,2}}|{_TOK},{_GAP}(?:{_TOK}|{_INI})(?:{_GAP}(?:{_TOK}|{_INI}))?|{_TOK}(?:{_GAP}(?:{_TOK}|{_INI})){{1,3}})(?![\w@])")
_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9])?(?: ?@ ?| ?[\[(] ?at ?[\])] ?)[A-Za-z0-9-]+(?:(?: ?\. ?| ?[\[(] ?dot ?[\])] ?)(?=[A-Za-z])[A-Za-z0-9-]+)+", re.I)
_PHONE = re.compile(r"(?<![\w/.+-])(?:(?:\+ ?91|0091|91(?=[ -]))[\s.-]?)?(?:\(0\)[\s.-]?)?(?:\(0\d{2,4}\)|\d)[\d .-]{6,16}\d(?![\w/])")
_ID = re.compile(r"(?<![\w/.-])(?:\d{4}[ -]?(?:\d{4}|[Xx*]{4})[ -]?\d{4}|[Xx*]{4}[ -]?[Xx*]{4}[ -]?\d{4}|[A-Z]{5}\d{4}[A-Z]|[A-Z]{3}\d{7}|[A-Z]\d{7}|[A-Z]{2}\d{2}[ -]?\d{11}|[A-Z]{2}[Xx*]{4,6}\d{2,4}[A-Z]?)(?![\w/]|-\d)")
_STREET = "|".join(STREETS)
_PLACE = r"(?:[A-Z][a-z]+|[A-Z]{3,})"
_ADDRESS = re.compile(
    rf"(?<![\w/.-])(?:(?:(?:[Ff]lat|FLAT|[Hh]ouse|HOUSE|[Dd]oor|DOOR|[Pp]lot|PLOT|Room|Shop|Villa|Apartment|Unit|Quarters|H|D)\.? ?(?:(?:No|NO|no)\.? ?|Number )?)?\d{{1,4}}[A-Z]?(?:[/-]\d{{1,4}}[A-Z]?)?(?: \(\d{{1,4}}\))?"
    rf",?{_GAP}(?:(?:Block|Phase|Sector|Wing|Tower|Floor|Ward|BLOCK|PHASE|SECTOR){_GAP}\w{{1,4}},?{_GAP})?(?:{_PLACE}{_GAP}){{1,2}}(?:{_STREET}|{_STREET.upper()})\b"
    rf"(?:,? near [a-z ]+)?(?:,?{_GAP}(?:P\.O\. )?{_PLACE}(?:(?: -)? \d{{3}} ?\d{{3}})?(?!:))?)"
)
#: A number before names: near-misses of addresses, mostly dates.
_AROUND_NUMBER = re.compile(rf"(?<![\w/.-])\d{{1,4}}[A-Z]?(?:[/-]\d{{1,4}}[A-Z]?)?,?{_GAP}(?:{_PLACE}{_GAP}){{0,2}}{_PLACE}(?!\w)")
_STREET_WORDS = (*STREETS, *map(str.upper, STREETS))
_STREET_WORD = re.compile(rf"\b(?:{_STREET}|{_STREET.upper()})\b")
_TITLE = re.compile(rf"^(?:(?:{'|'.join(TITLES)})\b\.?{_GAP})+", re.I)
_INITIAL = re.compile(r"\b[A-Z]\.")
_DOT = re.compile(r" ?\. ?| ?[\[(] ?dot ?[\])] ?", re.I)
_BEFORE = re.compile(r"[\w@'₹]+|[^\w\s]|\n")

#: What may begin an e-mail address, and anything around such a sign.
_AT = re.compile(r"@|[\[(] ?at ?[\])]", re.I)
_AROUND_AT = re.compile(r"(?<![\w.+-])[\w.+-]*(?: ?@ ?| ?[\[(] ?at ?[\])] ?)[\w%-]+(?:\.[\w-]+)*", re.I)

#: Cues for the labels of the sample, before a candidate: for it and against it.
_CUE = {
    "phone": (re.compile(r"\b(?:call|mobile|ph|phone|tel|contact|फ़ोन|फोन|संपर्क|ഫോൺ)\W*$", re.I), re.compile(r"(?:\b|(?<=₹))(?:number|receipt no\.?|no\.|of|section|act|rs\.?|rupees|₹|pan|uid|aadhaar|passport|card|id)\W*$", re.I)),
    "id_number": (re.compile(r"\b(?:pan|uid|aadhaar|passport|card(?: no\.?)?|id|ഐഡി)\W+(?:\w+\W+)?$", re.I), re.compile(r"(?:\b|(?<=₹))(?:number|receipt no\.?|ref:?|rs\.?|rupees|₹|call|mobile|ph|phone|contact)\W*$", re.I)),
    "address": (re.compile(r"(?:residing at|address:|[a-z],)\s*$|(?:^|\n)$", re.I), re.compile(r"(?:survey no\.?|no\.|section|rs\.?)\s*$", re.I)),
}


#: Digits of other scripts count as digits, one for one.
_OTHER_DIGITS = re.compile("[०-९൦-൯０-９٠-٩۰-۹]")
_DIGITS = str.maketrans({chr(zero + d): str(d) for zero in (0x0966, 0x0D66, 0xFF10, 0x0660, 0x06F0) for d in range(10)})


def plain_digits(text: str) -> str:
    return text.translate(_DIGITS) if not text.isascii() and _OTHER_DIGITS.search(text) else text


class Register:
    def __init__(self, parts: list[tuple[str, str]]):
        self.parts = {p.lower() for p, _ in parts}
        self.given = Counter(p.lower()[-3:] for p, k in parts if k != "surname")
        self.sur = Counter(p.lower()[-4:] for p, k in parts if k == "surname")

    def known(self, word: str, half: bool = False) -> bool:
        """Whether the register has a word; with ``half``, whether the half of it has it that training may see."""
        word = word.lower()
        return word in self.parts and not (half and hash64(word.encode()) & 1)

    def like(self, word: str) -> float:
        """How often the register has the ending of a word."""
        w = word.lower()
        return float(max(self.given.get(w[-3:], 0), self.sur.get(w[-4:], 0)))


#: Where a number or a name may begin; these are found far faster than the patterns themselves.
_NUMBER_STARTS, _PHONE_STARTS, _NAME_STARTS = re.compile(r"\d(?<![\w/.-].)"), re.compile(r"[\d(+](?<![\w/.+-].)"), re.compile(r"[A-Z](?<![\w@.+-].)[A-Za-z.]")
_ID_STARTS, _HOUSE_STARTS = re.compile(r"[\dA-Zx*](?<![\w/.-].)(?:\d{3}|[A-Z]{0,4}\d|[Xx*]{3}|[A-Z][Xx*])"), re.compile(r"[\dFHDPRSVAUQfhdp](?<![\w/.-].)(?:(?<=\d)|lat|LAT|ouse|OUSE|oor|OOR|lot|LOT|oom|hop|illa|partment|nit|uarters|\.|(?=[N\d ]))")


def _matches(starts: re.Pattern, pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """As ``pattern.finditer(text)``, tried only where ``starts`` matches."""
    end = 0
    for m in starts.finditer(text):
        if m.start() >= end and (found := pattern.match(text, m.start())):
            end = found.end()
            yield found


def propose(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all candidates, overlapping."""
    out = []
    text = plain_digits(text)
    for m in _matches(_NAME_STARTS, _NAME, text):
        start, own = m.start(), m[0]
        while True:  # drop titles and words that begin a line or sentence, not a name
            if t := _TITLE.match(own):
                start, own = start + t.end(), own[t.end() :]
                continue
            first = re.match(r"[A-Za-z]+[,.]?\s?", own)
            if first and len(first[0].strip(" ,.\n")) > 1 and first[0].strip(" ,.\n").lower() in NOT_NAMES:
                start, own = start + first.end(), own[first.end() :]
                continue
            break
        words = list(re.finditer(r"[A-Za-z]+", own))
        cut = next((w for w in words if len(w[0]) > 1 and w[0].lower() in NOT_NAMES), None)
        if cut:
            own = own[: cut.start()].rstrip(" ,\n")
            words = list(re.finditer(r"[A-Za-z]+", own))
        if sum(len(w[0]) > 1 for w in words) >= 1 and len(words) >= 2:
            out.append((start, start + len(own), "name"))
            # a line break may part two things
            if "\n" in own and not re.search(r",\n", own):
                for part in re.finditer(r"[^\n]+", own):
                    if len(re.findall(r"[A-Za-z]+", part[0])) >= 2:
                        out.append((start + part.start(), start + part.end(), "name"))
    if _AT.search(text):
        mails = [m.span() for m in _EMAIL.finditer(text)]
        near = [m.span() for m in _AROUND_AT.finditer(text)]
        out += [(a, b, "email") for a, b in mails + [n for n in near if all(n[1] <= a or n[0] >= b for a, b in mails)]]
    for m in _matches(_PHONE_STARTS, _PHONE, text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 14:
            out.append((m.start(), m.end(), "phone"))
    out += [(m.start(), m.end(), "id_number") for m in _matches(_ID_STARTS, _ID, text)]
    houses = [m.span() for m in _matches(_HOUSE_STARTS, _ADDRESS, text)] if any(map(text.__contains__, _STREET_WORDS)) else []
    near = [m.span() for m in _matches(_NUMBER_STARTS, _AROUND_NUMBER, text)]
    return out + [(a, b, "address") for a, b in houses + [n for n in near if all(n[1] <= a or n[0] >= b for a, b in houses)]]


def form(s: str) -> str:
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", re.sub(r"[Xx*]{4}", "#", s)))


class Rate:
    """Stands for the trees of a kind whose labels are too few or all alike: their smoothed rate, just under a half without any."""

    def __init__(self, labels: list[int]):
        self.rate = (sum(labels) + 1) / (len(labels) + 2) - 1e-6

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.rate)


class Model:
    """Trees, the log-odds of context words, and a threshold for each kind; ``untrained`` names the kinds that have a :class:`Rate` instead."""

    def __init__(self, register: Register):
        self.register, self.odds, self.cut = register, {}, dict.fromkeys(KINDS, 0.5)
        self.trees: dict[str, Trees | Rate] = {kind: Rate([]) for kind in KINDS}
        self.untrained = list(KINDS)

    def context(self, text: str, start: int, end: int) -> tuple[list[str], list[str]]:
        before = _BEFORE.findall(text[max(0, start - 40) : start])[-3:]
        after = _BEFORE.findall(text[end : end + 30])[:2]
        return ["^"] * (3 - len(before)) + [w.lower() for w in before], [w.lower() for w in after] + ["$"] * (2 - len(after))

    def features(self, text: str, start: int, end: int, kind: str, training: bool = False, alone: bool = False) -> list[float]:
        """In training half of the register is hidden, as it is incomplete: else it would tell the label. ``alone`` hides the context."""
        own = text[start:end]
        before, after = self.context(text, start, end)
        odds = lambda place, w: 0.0 if alone and place != "form" else self.odds.get((kind, place, w), 0.0)
        words = re.findall(r"[^\W\d_]{2,}", own)
        like = [self.register.like(w) for w in words]
        digits = sum(map(str.isdigit, own))
        out = [
            odds("b1", before[-1]), odds("b2", before[-2] + " " + before[-1]), odds("a1", after[0]), odds("a2", after[0] + " " + after[1]), odds("form", form(own)),
            float(len(own)), float(digits), float(len(words)), float(own.count(",")), float(own.isupper()), float("\n" in own), float(before[-1] in ("\n", "^")), float(after[0] in ("\n", "$", ",")),
        ]
        if kind == "name":
            out += [float(sum(x > 0 for x in like)) / max(1, len(like)), float(bool(_INITIAL.search(own))), float(any(self.register.known(w, training) for w in words))]
        if kind == "address":
            out += [float(len(_STREET_WORD.findall(own))), float(not own[:1].isdigit())]
        if kind == "email":
            local, _, domain = _AT.sub("@", own, count=1).partition("@")
            labels = _DOT.split(domain)
            out += [float(len(labels)), float(len(local.strip())), float(sum(map(str.isalpha, labels[-1]))), float(any(map(str.isdigit, labels[-1])))]
        return out

    def label(self, text: str, start: int, end: int, kind: str) -> int | None:
        """From clear cues only: 1, 0 or null."""
        own = text[start:end]
        if kind == "email":  # by its form: somebody at a domain that ends in letters
            return int(bool(_EMAIL.fullmatch(own)) and own[-1].isalpha())
        if kind == "name":
            # the register is incomplete: some names count as none here, which the trees outvote
            return int(any(self.register.known(w) for w in re.findall(r"[A-Za-z]{2,}", own)))
        yes, no = _CUE[kind]
        before = text[max(0, start - 30) : start]
        if kind == "address":  # by its form or its context
            if not _STREET_WORD.search(own):
                return 0
            if re.match(r"(?:flat|house|door|plot|h\.)", own, re.I):
                return 1
        return 0 if no.search(before) else 1 if yes.search(before) else None

    def fit(self, texts: list[str]) -> Model:
        """Trees from the candidates with a label, then again with those of which they are certain, whose contexts they learn so."""
        rows = [(i, t, *c, self.label(t, *c)) for i, t in enumerate(texts) for c in propose(t)]
        for left in reversed(range(ROUNDS)):
            doubtful = {k: at for k in KINDS if (at := [n for n, r in enumerate(rows) if r[4] == k and r[-1] is None])}
            if not left or not doubtful:
                break
            # only kinds with candidates that have no label need trees by now
            self._fit_once([r for r in rows if r[-1] is not None and r[4] in doubtful], tuple(doubtful))
            for kind in set(doubtful) - set(self.untrained):
                p = self.trees[kind].predict(np.array([self.features(*rows[n][1:5]) for n in doubtful[kind]]))
                for n, x in zip(doubtful[kind], p.tolist()):
                    if not 1 - CERTAIN < x < CERTAIN:
                        rows[n] = (*rows[n][:5], int(x > 0.5))
        self._fit_once([r for r in rows if r[-1] is not None])
        return self

    def _fit_once(self, rows: list[tuple[int, str, int, int, str, int]], kinds: tuple[str, ...] = KINDS) -> None:
        counts: dict[tuple, list[int]] = {}
        for _, t, s, e, k, y in rows:
            before, after = self.context(t, s, e)
            for key in ((k, "b1", before[-1]), (k, "b2", before[-2] + " " + before[-1]), (k, "a1", after[0]), (k, "a2", after[0] + " " + after[1]), (k, "form", form(t[s:e]))):
                counts.setdefault(key, [0, 0])[y] += 1
        # a context seen in few places tells nothing; without the cap a label would betray itself
        self.odds = {k: float(np.clip(np.log((b + 1) / (a + 1)), -3, 3)) for k, (a, b) in counts.items() if a + b >= 6}
        self.untrained = []
        for kind in kinds:
            own = [r for r in rows if r[4] == kind]
            labels = [r[-1] for r in own]
            if len(set(labels)) < 2 or len(own) < LEAST:
                self.trees[kind] = Rate(labels)
                self.untrained.append(kind)
                continue
            # each once with its context and once without, as a context may be new
            x = np.array([self.features(*r[1:5], True, alone) for alone in (False, True) for r in own])
            y, held = np.array(labels * 2, float), np.array([r[0] % 4 == 0 for r in own] * 2)
            tree = Trees().fit(x[~held], y[~held])
            p, y = tree.predict(x[held]), y[held]
            marks = np.linspace(0.2, 0.8, 13)
            right = np.array([2 * ((p >= m) & (y == 1)).sum() / max(1, ((p >= m).sum() + (y == 1).sum())) for m in marks])
            best = np.flatnonzero(right >= right.max() - 1e-9)
            self.trees[kind], self.cut[kind] = tree, float(marks[best[np.argmin(np.abs(marks[best] - 0.5))]])

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """The chosen spans of each text, by start."""
        spans = [(i, s, e, k) for i, t in enumerate(texts) if t for s, e, k in propose(t)]
        score = np.zeros(len(spans))
        for kind in KINDS:
            at = [n for n, x in enumerate(spans) if x[3] == kind]
            if at:
                score[at] = self.trees[kind].predict(np.array([self.features(texts[spans[n][0]], *spans[n][1:]) for n in at])) - self.cut[kind] + 0.5
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        order = sorted((n for n in range(len(spans)) if score[n] >= 0.5), key=lambda n: (spans[n][0], -round(score[n], 1), -(spans[n][2] - spans[n][1]), spans[n][1]))
        for n in order:
            i, s, e, k = spans[n]
            if all(e <= a or s >= b for a, b, _ in out[i]):
                out[i].append((s, e, k))
        return [sorted(x) for x in out]


def train(docs: DataFrame, register: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, max_register: int = MAX_REGISTER) -> Model:
    """Trees from at most ``sample`` documents, chosen by a hash of their ids."""
    parts = register.where("name_part is not null").select("name_part", "kind").distinct().limit(max_register + 1).collect()
    if len(parts) > max_register:
        raise ValueError("the register is larger than max_register")
    full = docs.where(F.length(text_col) > 0).select(text_col, id_col)
    rows = bounded_sample(full, id_col, full.count(), sample).collect()
    return Model(Register([(r.name_part, r.kind) for r in parts])).fit([r[0] for r in rows])


def _scan(docs: DataFrame, register: DataFrame, id_col: str, text_col: str, schema: str, rows_of) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(train(docs, register, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = part.column(1).to_pylist()
                yield rows_of(part, texts, model.value.find(texts))

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def find_personal(docs: DataFrame, register: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start_at, length): one row per occurrence, positions in code points from 1.

    Null and empty texts have none; occurrences never overlap; other columns are not read.
    """

    def rows_of(part: pa.RecordBatch, texts: list, found: list) -> pa.RecordBatch:
        at = [i for i, f in enumerate(found) for _ in f]
        flat = [x for f in found for x in f]
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(at, pa.int64())), pa.array([k for _, _, k in flat], pa.string()), pa.array([s + 1 for s, _, _ in flat], pa.int32()), pa.array([e - s for s, e, _ in flat], pa.int32())],
            names=[id_col, "kind", "start_at", "length"],
        )

    return _scan(docs, register, id_col, text_col, "kind string, start_at int, length int", rows_of)


def redact(docs: DataFrame, register: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, redacted): every text with typed placeholders for what :func:`find_personal` finds; null stays null."""

    def rows_of(part: pa.RecordBatch, texts: list, found: list) -> pa.RecordBatch:
        out = []
        for text, spans in zip(texts, found):
            for s, e, k in reversed(spans):
                text = text[:s] + PLACEHOLDERS[k] + text[e:]
            out.append(text)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=[id_col, "redacted"])

    return _scan(docs, register, id_col, text_col, "redacted string", rows_of)
