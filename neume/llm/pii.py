"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

Emails, ip addresses, card and phone numbers are found by pattern (``base_spans``), and stay.  The field
is trained from the labelled table in ``pii_examples`` and labels the words of every line, whole lines of any
length decoded by Viterbi in batches; its spans are added where they don't touch a span that is there already (phone
numbers in national form, social security numbers, secrets, names).

A word's features are its shape (letters, digits and signs by kind, runs squeezed), its length, and
whether it is a cue word; a place's emission adds those of the words beside it and the cues two words away.  A
decoded span must meet its kind's form (``_holds``): a card number passes Luhn, a social security number has nine
digits, a secret eight signs or more, every word of a name begins with a capital, and so on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.llm import crf
from neume.llm.common import small_batches, table
from neume.llm.pii_examples import EXAMPLES

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "secret", "ssn")
#: Emails and addresses are one word each and have just the pattern's form, so that the field could add none; secrets are one word.
LABELS = ["outside", *(f"first-{k}" for k in ("card", "phone", "name", "secret", "ssn")), *(f"next-{k}" for k in ("card", "phone", "name", "ssn"))]
CELLS = 512 * 256  # words of a batch of chains, padding included; a longer line is a batch of its own
PART = 1 << 20  # characters that are looked at together
PASSES = 25
#: From where a word's features are seen: two words before the word they speak of, to two after.
PLACES = (-2, -1, 0, 1, 2)
#: Distinct words, and kinds of words, that a task remembers (some 40 MB each) before it forgets them all.
MOST_WORDS, MOST_KINDS = 200_000, 60_000
#: Longer words are looked at anew each time: they are rare, and would fill the memory.
MOST_LETTERS = 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NO_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words that the field knows by themselves.
CUES = frozenset(
    "call phone tel fax mobile reach ring ssn social security token secret api_key password key mail contact host server card pay mr mrs ms dr dear name number "
    "dial cell whatsapp text pwd bearer passwort contraseña teléfono telefon prof sir miss herr frau sr sra señor señora mme sincerely regards signed by patient customer is no".split()
)
_HEX = re.compile(r"[\"'#*$%&]*[0-9A-Fa-f]{16,}[\"'#*$%&.,!]*")
_RUNS = re.compile(r"(.)\1+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(word: str) -> list[tuple[int, int]]:
    """Addresses in a word, leftmost first: each at sign's local part is the run of its signs before it, back to the
    address or at sign before; every sign is looked at twice at most."""
    out, low = [], 0
    pieces = word.split("@")
    at = 0
    for before in pieces[:-1]:
        at += len(before)
        start = max(low, at - len(_NO_LOCAL.split(before)[-1]))
        if start < at and (m := _DOMAIN.match(word, at)):
            out.append((start, m.end()))
            low = m.end()
        at += 1
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four exact patterns, by kind as listed, then start; matches that fail their test drop out."""
    out = []
    if "@" in text:
        # an address holds no white space, so words with an at sign are searched alone
        for word in _WORD.finditer(text):
            if "@" in word[0]:
                out += [("email", word.start() + s, word.start() + e) for s, e in _emails(word[0])]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _core(word: str) -> str:
    return word.strip(".,;:!?\"'()[]#*$%&").lower()


def _names(word: str) -> tuple[str, ...]:
    """The features of a word."""
    core = _core(word)
    cue = (f"c{core}",) if core in CUES else ()
    end = "" if word[-1:].isalnum() else word[-1:]
    if not any(map(str.isdigit, word)) and "@" not in word and "=" not in word:
        # words of letters look alike but for how they begin and end
        return (("sX" if word[:1].isupper() else "sx") + ("." if end and end in ".,;:!?" else "#" if end else ""), *cue, f"e{end}")
    digits = sum(map(str.isdigit, word))
    squeezed = _RUNS.sub(r"\1+", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word))
    size = min(len(core), 12) if any(map(str.isdigit, core)) else 0
    hexlike = ("hex",) if digits and _HEX.fullmatch(word) else ()
    mixed_case = ("mix",) if digits and any(map(str.isalpha, word)) else ()
    return (f"s{squeezed}", f"n{size}", f"d{min(digits, 11)}", *cue, *hexlike, *mixed_case, f"e{end}")


def _seen_from(names: tuple[str, ...], place: int) -> Iterator[str]:
    """The features that a place ``place`` words away sees of a word."""
    return (n for n in names if abs(place) < 2 or n.startswith("c"))


class Field:
    """The trained field: feature numbers by name and place, and the weights over them."""

    def __init__(self, features: dict[tuple[str, int], int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray) -> None:
        self.features, self.weights = features, weights
        self.moves, self.start = moves.astype(np.float32), start.astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        """No words known: row 0 stands for the places beside a line."""
        self.rows: dict[str, int] = {}
        self.kinds: dict[tuple[str, ...], int] = {(): 0}
        self.plain: dict[tuple[bool, str], int] = {}
        self.table = np.zeros((1024, len(PLACES), len(LABELS)), np.float32)

    def _vectors(self, names: tuple[str, ...]) -> np.ndarray:
        out = np.zeros((len(PLACES), len(LABELS)))
        for k, place in enumerate(PLACES):
            for name in _seen_from(names, place):
                if (at := self.features.get((name, place))) is not None:
                    out[k] += self.weights[at]
        return out

    def _row(self, word: str) -> int:
        body = word if word.isalpha() else word[:-1]
        end = word[len(body) :]
        if not body.isalpha() or (end and end not in ".,;:!?") or body.lower() in CUES:
            return self._new_row(word)
        # most words: all letters, and a sign after them
        if (at := self.plain.get((word[0].isupper(), end))) is None:
            at = self.plain[word[0].isupper(), end] = self._new_row(word)
        if len(word) <= MOST_LETTERS:
            self.rows[word] = at
        return at

    def _new_row(self, word: str) -> int:
        names = _names(word)
        if (at := self.kinds.get(names)) is None:
            at = self.kinds[names] = len(self.kinds)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = self._vectors(names)
        if len(word) <= MOST_LETTERS:
            self.rows[word] = at
        return at

    def decode(self, words: list[list[str]]) -> list[np.ndarray]:
        """The best label of every word of every line."""
        if len(self.rows) > MOST_WORDS or len(self.kinds) > MOST_KINDS:
            self._forget()
        known, row, reach = self.rows.get, self._row, max(PLACES)
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths + reach) - lengths - reach
        ids = np.zeros(int((lengths + reach).sum()) + reach, np.int64)  # 0: nothing there, before, between and after lines
        for line, start in zip(words, starts + reach, strict=True):
            ids[start : start + len(line)] = [row(w) if (at := known(w)) is None else at for w in line]
        out = [np.zeros(n, np.int8) for n in lengths]
        if not words:
            return out
        # what the words before a place, its own, and those after it say of it
        n = len(ids) - 2 * reach
        emissions = self.table[ids[:n], 0].copy()
        for k, p in enumerate(PLACES[1:], 1):
            emissions += self.table[ids[reach + p : reach + p + n], k]
        for own in _batched(lengths.tolist()):
            chosen = np.array(own)
            steps = np.arange(int(lengths[chosen].max()))
            at = np.minimum(starts[chosen][:, None] + steps, n - 1)
            labels = crf.viterbi(emissions[at], lengths[chosen], self.moves, self.start)
            for r, found in zip(chosen, labels, strict=True):
                out[r] = found[: lengths[r]]
        return out


def _marked(example: str) -> tuple[list[str], list[int]]:
    words, labels = [], []
    for part in re.split(r"(\{\w+:[^}]*\})", example):
        kind, inner = re.fullmatch(r"\{(\w+):([^}]*)\}", part).groups() if part.startswith("{") else ("", part)
        for i, w in enumerate(_WORD.findall(inner)):
            if not kind and i == 0 and words and not part[:1].isspace():
                words[-1] += w  # a sign right after a span belongs to the span's last word
                continue
            words.append(w)
            label = f"{'next' if i else 'first'}-{kind}"
            labels.append(LABELS.index(label) if label in LABELS else 0)
    return words, labels


def train(examples: tuple[str, ...] = EXAMPLES) -> Field:
    """Learn the field's weights; a few seconds, on the driver, from a table of constant size."""
    lines = [_marked(e) for e in examples]
    features: dict[tuple[str, int], int] = {}
    types: dict[tuple, int] = {}
    chains, golds = [], []
    for words, labels in lines:
        names = [(), (), *(_names(w) for w in words), (), ()]
        chain = []
        for i in range(2, len(names) - 2):
            # the word before is read at place -1 of its own features, and so on
            own = tuple((n, p) for p in PLACES for n in _seen_from(names[i + p], p))
            for f in own:
                features.setdefault(f, len(features))
            chain.append(types.setdefault(own, len(types)))
        chains.append(np.array(chain))
        golds.append(np.array(labels))
    ragged = crf.RaggedFeatures([np.array([features[f] for f in own], np.int64) for own in types])
    weights, moves, start = crf.train(chains, golds, ragged, len(features), len(LABELS), PASSES, rate=0.2, l2=1e-3, batch=16)
    return Field(features, weights, moves, start)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Signs that stand round a span are not part of it (brackets that open inside it are)."""
    while start < end and text[start] in "\"'[<,;:*#$%&":
        start += 1
    while end > start and text[end - 1] in "\"'.,;:!?]>*#$%&":
        end -= 1
    return start, end


def find(field: Field, texts: list[str | None]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text; all spans by kind as in KINDS, then start."""
    out = []
    for part in _parts(texts):
        lines = [(i, at, line) for i, text in enumerate(part) for at, line in _lines(text or "")]
        words = [_WORD.findall(line) for _, _, line in lines]
        extra: list[list[tuple[str, int, int]]] = [[] for _ in part]
        for (i, at, line), own, labels in zip(lines, words, field.decode(words), strict=True):
            if labels.any():
                extra[i] += _spans(part[i], own, [at + m.start() for m in _WORD.finditer(line)], labels)
        for text, more in zip(part, extra, strict=True):
            base = base_spans(text) if text else []
            kept = _apart(more, base)
            out.append((base, sorted(base + kept, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
    return out


def _apart(more: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans of ``more`` (which don't overlap) that touch none of ``base`` (which may), in one walk over both."""
    out, taken, at, reach = [], sorted((s, e) for _, s, e in base), 0, 0
    for kind, s, e in sorted(more, key=lambda x: x[1]):
        while at < len(taken) and taken[at][0] < e:  # ``reach``: how far those that begin before this one's end go
            reach = max(reach, taken[at][1])
            at += 1
        if s < e and reach <= s:
            out.append((kind, s, e))
    return out


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in parts of some ``PART`` characters (or one longer text)."""
    own: list[str | None] = []
    size = 0
    for text in texts:
        own.append(text)
        size += len(text or "")
        if size >= PART:
            yield own
            own, size = [], 0
    if own:
        yield own


def _lines(text: str) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that hold anything."""
    at = 0
    for line in text.split("\n"):
        if line:
            yield at, line
        at += len(line) + 1


def _batched(lengths: list[int]) -> Iterator[list[int]]:
    """Places of ``lengths`` in batches of like length: 512 at most, of ``CELLS`` words when padded."""
    own: list[int] = []
    for r in sorted(range(len(lengths)), key=lengths.__getitem__):
        if own and (len(own) == 512 or (len(own) + 1) * lengths[r] > CELLS):
            yield own
            own = []
        own.append(r)
    if own:
        yield own


def _spans(text: str, words: list[str], offsets: list[int], labels: np.ndarray) -> list[tuple[str, int, int]]:
    out, at = [], 0
    while at < len(labels):
        if not labels[at]:
            at += 1
            continue
        kind, end = LABELS[labels[at]].partition("-")[2], at + 1
        while end < len(labels) and LABELS[labels[end]] == f"next-{kind}":
            end += 1
        start, stop = _trimmed(text, offsets[at], offsets[end - 1] + len(words[end - 1]))
        if start < stop and _holds(kind, text[start:stop]):
            out.append((kind, start, stop))
        at = end
    return out


def _holds(kind: str, found: str) -> bool:
    """Whether a decoded span has its kind's form."""
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "name":
        return len(found) > 1 and not digits and all(w[0].isupper() for w in found.split())
    if kind == "secret":
        return len(found) >= 8 and any(c.isalnum() for c in found)
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "ssn":
        return len(digits) == 9
    return kind == "phone" and 7 <= len(digits) <= 15


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row per row, no shuffle.

    Offsets are code points, ends exclusive.  Null and empty texts have no spans: counts 0, the digest of
    the empty string, and an empty ``spans``.  Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    field = train()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = find(field, list(batch.text))
            out = {"doc_id": batch.doc_id}
            for kind in BASE:
                out[f"n_{kind}"] = [sum(k == kind for k, _, _ in base) for base, _ in found]
            out["base_sha256"] = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [_joined(spans) for _, spans in found]
            yield pd.DataFrame(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op7_personal_data": op7_personal_data}
ORACLE: dict[str, str] = {}
