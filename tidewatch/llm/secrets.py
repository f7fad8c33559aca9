"""Secret scans: pattern spans, and dictionary-primed zstandard novelty for strings that no pattern names.

A candidate is a long unbroken string.  It is compressed behind what surrounds it, with a dictionary of common identifiers
and words loaded first; the bytes that it adds are its marginal cost.  Names, prose and repeats of the surroundings cost
little, random strings cost nearly their entropy.  A candidate is reported if it is incompressible in that sense and a word
that speaks of secrets stands shortly before it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import kept

# Fixed patterns: the three kinds of base span, in the order in which equal starts are listed.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: The least length of a candidate of its own, and what one is made of.
LEAST = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~$.-]{%d,}" % LEAST, re.ASCII)
_CONTEXT = re.compile(r"secret|passw|passphrase|token|credential|api.?key|access.?key|private|auth|bearer|signature|salt|pwd", re.IGNORECASE | re.ASCII)
#: Names with their "=" at the front of a candidate: what follows is the value.
_NAME = re.compile(r"(?:[A-Za-z_~$.-][\w~$.-]*=(?!=))+", re.ASCII)
#: Characters before a candidate in which a sensitive word counts, and characters on both sides that prime the compressor.
SENSITIVE, AROUND = 48, 256
#: Least marginal bytes for each character: random base64 costs about 0.75, random hex 0.5, words under 0.4.
NOVELTY = 0.5
#: Least Shannon entropy of the characters, in bits: below it a string repeats itself.
ENTROPY = 3.0

# Words of the dictionary: common identifiers of configuration and code, and plain words.
IDENTIFIERS = (
    "password secret token apikey api_key access_key private_key client_secret credentials authorization bearer username config default "
    "environment application production development database connection string return function import export const static public private "
    "class object value index length number boolean undefined null true false http https localhost example com org net www index html "
    "content type accept encoding charset utf-8 user admin root host port path file name version description timeout retry request response "
    "session cookie header body message error warning info debug status code created updated deleted abcdefghijklmnopqrstuvwxyz 0123456789 "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ the and that have for not with you this but his from they say her she will one all would there their what"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern spans: leftmost and not overlapping within a kind, too short ones left out afterwards."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    # A maximal run of at least 24 is the same span as a run of any length that is then held to 24.
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


class Novelty:
    """Marginal compressed bytes of a string behind its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        import zstandard

        primer = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primer, write_content_size=False, write_checksum=False)

    def cost(self, before: str, candidate: str, after: str) -> float:
        """Bytes per character that ``candidate`` adds to the surroundings that it stands in."""
        around = (before + after).encode("utf-8", "surrogatepass")
        both = around + candidate.encode()
        return max(0, len(self.compressor.compress(both)) - len(self.compressor.compress(around))) / len(candidate)


def _uncovered(a: int, b: int, covered: list[list[int]], at: int) -> list[tuple[int, int]]:
    """The parts of a..b outside ``covered``, sorted spans without overlaps of which those before ``at`` end before a."""
    out = []
    while at < len(covered) and covered[at][0] < b:
        if covered[at][0] > a:
            out.append((a, covered[at][0]))
        a = max(a, covered[at][1])
        at += 1
    return [*out, (a, b)] if a < b else out


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible strings in a sensitive context; of one that runs into a span in ``taken``, the parts outside that are long enough."""
    out = []
    covered: list[list[int]] = []  # what the spans cover, without overlaps
    for x, _, y in sorted(taken):
        if covered and x < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], y)
        else:
            covered.append([x, y])
    at = 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        name = _NAME.match(text, a, b)
        if name and b - name.end() >= LEAST:
            a = name.end()
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        for x, y in _uncovered(a, b, covered, at):
            s = text[x:y]
            if y - x < LEAST or not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
                continue
            if not _CONTEXT.search(text, max(0, x - SENSITIVE), x) or _entropy(s) < ENTROPY:
                continue
            if novelty.cost(text[max(0, x - AROUND) : x], s, text[y : y + AROUND]) >= NOVELTY:
                out.append((x, 3, y))
    return out


_novelty: list[Novelty] = []


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_SPAN = T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType())


def secret_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, ``spans`` (kind, start, end in code points) by start and kind, for each row.

    Kinds assign, access and hex are patterns, novel is the compressor's.  Null and empty texts have no spans; every text is
    scanned whole, row by row, so repeated rows repeat their result.
    """

    def run(batches):
        if not _novelty:
            _novelty.append(Novelty())
        for pdf in batches:
            out = []
            for text in pdf["__text"]:
                base = base_spans(text) if text else []
                extra = novel_spans(text, base, _novelty[0]) if text else []
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + extra)])
            yield pdf.drop(columns="__text").assign(spans=out)

    src = documents.select(*[F.col(c) for c in kept(id_col, keep, "spans")], F.col(text_col).alias("__text"))
    return src.mapInPandas(run, src.drop("__text").schema.add("spans", T.ArrayType(_SPAN)))


def digest(documents: DataFrame) -> DataFrame:
    """The registered query's columns, from the operator's spans."""
    one = "concat_ws(':', s.kind, s.start, s.end)"
    count = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.expr(f"array_join(transform(filter(spans, s -> s.kind != 'novel'), s -> {one}), ',')")
    return secret_spans(documents).select("doc_id", *count, F.sha2(base, 256).alias("base_sha256"), F.expr(f"array_join(transform(spans, s -> {one}), ',')").alias("spans"))


__all__ = ["Novelty", "base_spans", "digest", "novel_spans", "secret_spans"]
