"""Best-fit packing by a grouping genetic algorithm, distributed as islands with elite migration.

A piece is a document's token ids, or 2048 of them where it is longer.  Pieces are dealt to shards by hash.  Each shard is packed by
several islands: populations that start from best-fit packings of differently perturbed orders.  Crossover puts whole
well-filled bins of one parent in front of another's, drops bins that hold a piece twice, and fits the pieces set free best-fit;
after each epoch the best packing of an island migrates to the next island of its shard.  A shard is done when it needs no more
sequences than its tokens do.  Pieces of sequences that stay below ``WELL_FILLED`` are dealt anew to fewer shards and packed again.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import as_bytes, distinct_words, slices

LENGTH = 2048
#: Pieces of a shard, about.
SHARD = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
GENERATIONS = 12
WELL_FILLED = 0.97
#: Distinct chunks between white space in a generation; a worker remembers two generations.
REMEMBERED = 500_000


#: A chunk that is a word of plain Latin letters (ASCII, and U+00C0 to U+017F without the multiplication and division signs and the
#: dotted capital I, whose small form is two characters) and punctuation behind it, an apostrophe apart: at most two units of the
#: tokenizer.  Any other line is the third group.
_PLAIN = re.compile(rb"^(?:((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+)([!-&(-/:-@\[-`{-~]*)|(.+))$", re.MULTILINE)
#: Units in one text for the tokenizer.
BULK = 2_000


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: printable ones as they are, the others from 256 on, and here a space for the space."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)} | {32: " "}


_LETTERS = _byte_letters()


class Tokens:
    """Ids of texts, by the tokenizer itself for each new chunk between white space and from memory afterwards.

    The tokenizer drops white space and never joins across it, nor from a letter to punctuation, and it lower-cases, so a text's
    ids are those of its chunks in turn.  Chunks not met for a whole generation are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # The same model for units that are normalised and split already.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _odd(self, chunks: list[bytes]) -> None:
        """Chunks one by one."""
        for i in range(0, len(chunks), 5000):
            part = chunks[i : i + 5000]
            got = self.tokenizer.encode_batch_fast([c.decode("utf-8", "surrogatepass") for c in part], add_special_tokens=False)
            for c, e in zip(part, got, strict=True):
                self.known[c] = np.array(e.ids, "<u4").tobytes()

    def _units(self, units: list[bytes]) -> None:
        """Words and runs of punctuation, each one unit: many are encoded as one text, which is cut where a token ends a word."""
        parts = [units[i : i + BULK] for i in range(0, len(units), BULK)]
        texts = [b" ".join(p).decode().lower().encode().decode("latin-1").translate(_LETTERS) for p in parts]
        for part, e in zip(parts, self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part):  # not a tokenizer of one end for each word
                self._odd(part)
                continue
            raw, at = ids.tobytes(), 0
            for u, end in zip(part, ends, strict=True):
                self.known[u] = raw[at:end]
                at = end

    def _learn(self, chunks: set[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        # One by one: the difference of a set and a dictionary's keys goes through all of the keys.
        known, before = self.known, self.before
        known.update([(c, before[c]) for c in chunks if c in before])
        new = [c for c in chunks if c not in before]
        split, odd, units = [], [], set()
        for c, (word, tail, other) in zip(new, _PLAIN.findall(b"\n".join(new)), strict=True):
            if other:
                odd.append(c)
            elif tail:
                split.append((c, word, tail))
                units.add(word)
                units.add(tail)
            else:
                units.add(c)
        known.update([(u, before[u]) for u in units if u in before and u not in known])
        self._units([u for u in units if u not in known])
        self._odd(odd)
        known.update([(c, known[word] + known[tail]) for c, word, tail in split])

    def __call__(self, texts: list) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, and id 0 at the end."""
        raw, out = [as_bytes(t) for t in texts], []
        for i, j in slices(raw, 2 << 20):
            out += self._slice(raw[i:j])
        return out

    def _slice(self, texts: list[bytes]) -> list[bytes]:
        """Each distinct word of a slice is looked up once, and the ids are dealt out in numpy."""
        chunks, which, first = distinct_words(texts)
        ids = [*map(self.known.get, chunks)]
        missing = [k for k, v in enumerate(ids) if v is None]
        self._learn({chunks[k] for k in missing})
        for k in missing:
            ids[k] = self.known[chunks[k]]
        ids.append(b"\0\0\0\0")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = np.cumsum(size) - size
        which = np.insert(which, first[1:], len(chunks))
        n = size[which]
        end = np.cumsum(n)
        got = flat[np.repeat(begin[which] - end + n, n) + np.arange(end[-1])] if len(end) else flat[:0]
        # The end of a text is the one-token word behind its last word.
        cut = [0, *end[first[1:] + np.arange(len(texts))].tolist()]
        return [got[p:q].tobytes() for p, q in zip(cut, cut[1:], strict=False)]


_tokens: dict[str, Tokens] = {}


def _pieces(path: str, length: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the other cores have tasks of their own
        if path not in _tokens:
            _tokens[path] = Tokens(path)
        tokens = _tokens[path]
        for pdf in batches:
            ids, texts = list(pdf["id"]), list(pdf["text"])
            for a in range(0, len(texts), 2000):
                rows = []
                for i, raw in zip(ids[a : a + 2000], tokens(texts[a : a + 2000]), strict=True):
                    for k in range(0, len(raw), 4 * length):
                        part = raw[k : k + 4 * length]
                        rows.append((i, k // (4 * length), k // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "crc"])

    return run


def best_fit(sizes: np.ndarray, order: Iterator[int], capacity: int, bins: list[list[int]], room: list[int]) -> None:
    """Put each piece of ``order`` into the fullest bin that has room; ``bins`` and their ``room`` grow in place."""
    open_ = sorted((r, b) for b, r in enumerate(room) if r)
    for p in order:
        s = int(sizes[p])
        at = bisect_left(open_, (s, -1))
        if at < len(open_):
            r, b = open_.pop(at)
            bins[b].append(p)
        else:
            r, b = capacity, len(bins)
            bins.append([p])
            room.append(0)
        room[b] = r - s
        if r > s:
            insort(open_, (r - s, b))


def fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the more unequal their filling: that is what later crossovers can use."""
    return -len(room), sum((1 - r / capacity) ** 2 for r in room)


class Island:
    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity = sizes, capacity
        self.rng = np.random.default_rng(seed)
        self.least = -(-int(sizes.sum()) // capacity)
        self.people: list[tuple[list[list[int]], list[int]]] = []

    def done(self) -> bool:
        return bool(self.people) and len(self.best()[0]) <= self.least

    def best(self):
        return max(self.people, key=lambda x: fitness(x[1], self.capacity))

    def settle(self, elite: list[list[int]] | None) -> None:
        if elite is not None:
            self.people.append((elite, [self.capacity - int(self.sizes[b].sum()) for b in elite]))
        while len(self.people) < POPULATION and not self.done():
            noise = 1 + 0.25 * len(self.people) * self.rng.random(len(self.sizes))
            bins, room = [], []
            best_fit(self.sizes, iter(np.argsort(-self.sizes * noise, kind="stable").tolist()), self.capacity, bins, room)
            self.people.append((bins, room))

    def crossover(self, mother, father):
        """The father's best-filled bins as they stand, the mother's bins without those pieces, best-fit for the rest."""
        take = sorted(range(len(father[1])), key=lambda b: father[1][b])
        take = take[: int(self.rng.integers(1, max(2, len(take) // 2)))]
        taken = np.zeros(len(self.sizes), bool)
        bins, room = [], []
        for b in take:
            taken[father[0][b]] = True
            bins.append(father[0][b])
            room.append(father[1][b])
        free: list[int] = []
        for b, r in zip(*mother, strict=True):
            if not taken[b].any():
                bins.append(b)
                room.append(r)
            else:
                free += [p for p in b if not taken[p]]
        bins = [list(b) for b in bins]
        best_fit(self.sizes, iter(sorted(free, key=lambda p: -self.sizes[p])), self.capacity, bins, room)
        return bins, room

    def evolve(self, generations: int) -> None:
        for _ in range(generations):
            if self.done() or len(self.people) < 2:
                return
            ranked = sorted(self.people, key=lambda x: fitness(x[1], self.capacity), reverse=True)
            i, j = self.rng.choice(len(ranked), 2, replace=False)
            child = self.crossover(ranked[max(i, j)], ranked[min(i, j)])
            self.people = [*ranked[: POPULATION - 1], child]


def _epoch(capacity: int, generations: int):
    """One island for one epoch: its pieces, in a fixed order, with the bin that the arriving elite gives each (or -1)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        island = Island(sizes, capacity, seed=int(key[0]) * 31 + int(key[1]))
        bins = pdf["bin"].to_numpy()
        elite = [list(g) for g in pdf.groupby("bin", sort=True).indices.values()] if len(bins) and bins[0] >= 0 else None
        island.settle(elite)
        island.evolve(generations)
        best, room = island.best()
        bin_, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, pieces in enumerate(best):
            bin_[pieces] = b
            offset[pieces] = np.concatenate(([0], np.cumsum(sizes[pieces])[:-1]))
        full = np.array([capacity - r for r in room])
        return pdf.assign(bin=bin_, offset=offset, fill=full[bin_], fit=fitness(room, capacity)[1], bins=len(best), least=island.least)

    return run


_STATE = "id long, piece int, start long, length long, crc long, shard long, island int, bin long, offset long, fill long, fit double, bins int, least int"


def _pack(pieces: DataFrame, shards: int, scratch: Scratch, capacity: int, seed: int) -> DataFrame:
    """Pieces dealt to shards and packed: the best island's bin and offset for each piece."""
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id", "piece", "start"), F.lit(shards)))
    state = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).withColumn("bin", F.lit(-1).cast("long"))
    names = [c.split()[0] for c in _STATE.split(", ")][:8]
    done = None
    for epoch in range(EPOCHS):
        out = scratch.save(state.select(*names).groupBy("shard", "island").applyInPandas(_epoch(capacity, GENERATIONS), _STATE))
        rank = out.groupBy("shard").agg(F.max_by("island", F.struct(-F.col("bins"), "fit", -F.col("island"))).alias("island"), (F.min("bins") <= F.min("least")).alias("ok"))
        best = out.join(rank, ["shard", "island"])
        # Shards at their lower bound are packed; elsewhere each island's best goes to its neighbour.
        ready = best if epoch == EPOCHS - 1 else best.where("ok")
        done = ready.drop("ok") if done is None else done.unionByName(ready.drop("ok"))
        going = rank.where("not ok").select("shard")
        if epoch == EPOCHS - 1 or going.isEmpty():
            break
        state = out.join(going, "shard").withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
    return done.drop("island", "fit", "bins", "least")


def pack(documents: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """One row per piece: id, piece (from 0), start, length, ids_crc32, sequence_id, offset.

    A document's tokens are its ids by ``tokenizer`` (a path that every executor can read) and id 0; null and empty texts
    are that one token.  Only documents over ``length`` are cut.  Rows that share an id, and a null id, are packed row by
    row.  Sequence numbers are distinct but not dense, and an empty table has no pieces.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    scratch = Scratch(documents.sparkSession, "packing")
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = scratch.save(docs.mapInPandas(_pieces(tokenizer, length), "id long, piece int, start long, length long, crc long"))
    part = rows.where(F.col("length") < length)
    shards = max(1, -(-part.count() // shard))
    packed = scratch.save(_pack(part, shards, scratch, length, 1))

    poor = packed.where(F.col("fill") < WELL_FILLED * length)
    good = packed.where(F.col("fill") >= WELL_FILLED * length).withColumn("level", F.lit(1))
    again = _pack(poor.select("id", "piece", "start", "length", "crc"), max(1, -(-poor.count() // shard)), scratch, length, 2).withColumn("level", F.lit(2))
    numbered = good.unionByName(again).withColumn("sequence_id", F.expr("shiftleft(cast(level as bigint), 60) | shiftleft(shard, 20) | bin"))
    # A full piece is a sequence of its own: a number from where the row stands, one table being one set of partitions.
    whole = rows.where(F.col("length") == length).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    names = [F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset"]
    return numbered.select(*names).unionByName(whole.select(*names))
