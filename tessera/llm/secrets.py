"""Secret scan by zstandard novelty against surrounding text and an identifier dictionary."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import most_frequent, token_counts

KINDS = ("assign", "access", "hex")


def either_case(words: str) -> str:
    """Letters of a pattern in either case, ASCII only."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


#: Base patterns (fixed values) and the least length of what they must catch.
BASE = {
    "assign": (re.compile(either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}
#: Words that make what follows sensitive (fixed values).
SENSITIVE = re.compile(either_case(r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credential") + r"(?![a-z])")
SHORTEST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=~.-]{{{SHORTEST},}}")
#: Names without digits: a secret that is copied around must not become part of the dictionary.
IDENTIFIER = r"(?<![A-Za-z0-9_])[A-Za-z_]{3,32}(?![A-Za-z0-9_])"
#: How far a sensitive word reaches, and how much text on either side a candidate is held against.
REACH, AROUND = 64, 256
#: Identifiers of the dictionary; compression level; bytes per character from which a candidate is new, and the
#: least of them. At this level random strings of 16 to 40 characters cost 0.75 or more, joined words 0.55 on average.
IDENTIFIERS, LEVEL, RATIO, LEAST = 4096, 19, 0.72, 9


def dictionary(docs: DataFrame, size: int = IDENTIFIERS) -> bytes:
    """The most frequent identifiers (twice at least) of all texts, the most frequent last, where matches are cheapest."""
    return " ".join(t for t, _ in reversed(most_frequent(token_counts(docs, IDENTIFIER), size, 2))).encode()


class Novelty:
    """Marginal compressed bytes of a string, given text around it and the identifier dictionary."""

    def __init__(self, words: bytes, level: int = LEVEL):
        content = words if len(words) >= 8 else b"identifier"
        primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self.size = lambda b, c=zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False): len(c.compress(b))

    def of(self, around: str, value: str) -> int:
        base = around.encode()
        return self.size(base + b"\n" + value.encode()) - self.size(base)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base patterns find, in code points."""
    out = []
    for k, kind in enumerate(KINDS):
        pattern, group, least = BASE[kind]
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def surroundings(text: str, start: int, end: int) -> str:
    """The text on either side of text[start:end] without other copies of it, punctuation at its ends aside.

    A copy that the border of the surroundings would cut goes as a whole.
    """
    value = text[start:end]
    core = value.strip("+/_=~.-")
    core = core if len(core) >= SHORTEST else value
    far = AROUND + len(core) - 1
    left, right = text[max(0, start - far) : start], text[end : end + far]
    return left.replace(core, "")[-AROUND:] + right.replace(core, "")[:AROUND]


def novel_spans(text: str, novelty: Novelty, base: list[tuple[int, int, int]], ratio: float = RATIO, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, marginal bytes) of sensitive strings that do not compress and touch no base span."""
    out, done = [], 0
    for cue in SENSITIVE.finditer(text):
        for m in CANDIDATE.finditer(text, max(done, cue.end()), min(len(text), cue.end() + REACH + SHORTEST - 1)):
            # A match starts within the reach and ends a little after it; the string itself goes on.
            end = CANDIDATE.match(text, m.start()).end()
            if m.start() < done or any(s < end and m.start() < e for s, _, e in base):
                continue
            done = end
            value = text[m.start() : end]
            new = novelty.of(surroundings(text, m.start(), end), value)
            if new >= least and new >= ratio * len(value):
                out.append((m.start(), end, new))
    return out


def scanner(words: bytes, ratio: float, least: int):
    """Task function: one row of findings for every row (doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for x in batch.column(1):
                text = x.as_py()
                base = base_spans(text)
                new = novel_spans(text, novelty, base, ratio, least)
                named = [(s, k, e, KINDS[k]) for s, k, e in base]
                every = sorted(named + [(s, len(KINDS), e, "novel") for s, e, _ in new])
                row = [sum(b[1] == k for b in base) for k in range(len(KINDS))]
                row.append(hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, e, n in named).encode()).hexdigest())
                row.append(",".join(f"{n}:{s}:{e}" for s, _, e, n in every))
                row.append(len(new))
                for c, v in zip(columns, row):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, type=t) for c, t in zip(columns, kinds)]], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_novel"])

    return scan


def secret_table(docs: DataFrame, ratio: float = RATIO, least: int = LEAST, identifiers: int = IDENTIFIERS) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans, and all spans by start and kind.

    Base spans are always kept. A string of 12 or more characters that starts within 64 of a sensitive
    word comes on top as ``novel`` if appending it to the text around it, other copies of the string
    left out, costs at least ``least`` bytes and ``ratio`` bytes a character under zstandard, primed
    with the ``identifiers`` most frequent identifiers of all texts: it repeats neither the code around
    it nor common names, and a secret that stands there twice is reported twice. Null texts are
    empty, empty tables give no rows, repeated rows are scanned each for itself, and only ``doc_id``
    and ``text`` are read. Nothing but token counts is shuffled.
    """
    words = dictionary(docs, identifiers)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(scanner(words, ratio, least), schema)
