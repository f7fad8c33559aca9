"""Conversation structure repair against brute force: costs, least audits, repaired texts, whole conversations and pieces."""

import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from tidewatch.llm import auction, conversations, queries

ROWS = "conv_id long, turn long, role string, text string, conv string, kind int, piece int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ROWS)


def faults(rows):
    """Turn rows (turn, role, text) in order with their kinds."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, out = set(), []
    for turn, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            kind = auction.BLANK
        elif (role, text) in seen:
            kind = auction.DUPLICATE
        else:
            kind = auction.SOUND if re.search(r"[^\x20\x09-\x0D]", text[::-1])[0] in ".!?" else auction.TRUNCATED
        seen.add((role, text))
        out.append((turn, role, text, kind))
    return out


def cheapest(initials, kinds):
    """(cost, audit, exits): dynamic programming from the end, where the first label decides among suffixes."""
    best = {0: (0, ""), 3: (0, "")}

    def insert(best):
        for _ in range(2):
            for q in range(4):
                to = auction.NEXT[q]
                if to in best:
                    best[q] = min(best.get(q, (10**9, "")), (best[to][0] + 2, "I" + best[to][1]))
        return best

    insert(best)
    for initial, kind in zip(reversed(initials), reversed(kinds), strict=True):
        now = {}
        for q in range(4):
            options = [(best[q][0] + 3, "D" + best[q][1])]
            if kind not in (auction.BLANK, auction.DUPLICATE):
                extra = int(kind == auction.TRUNCATED)
                to = best[auction.NEXT[q]]
                options.append((to[0] + 2 + extra, "R" + to[1]))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, initial))
                if kept is not None:
                    options.append((best[kept][0] + extra, "K" + best[kept][1]))
            now[q] = min(options)
        best = insert(now)
    return best[0]


def expected(rows):
    turns = faults(rows)
    cost, audit = cheapest([r[1][:1] for r in turns], [r[3] for r in turns])
    out, state, left = [], "", list(turns)
    for label in audit:
        role = "assistant" if state.endswith("u") else "user"
        if label == "I":
            out.append(f"{role}:")
        else:
            turn, own, text, kind = left.pop(0)
            if label == "D":
                continue
            role = role if label == "R" else own
            out.append(f"{role}:{text}")
        state += role[:1]
    assert re.fullmatch("(s?(ua)+)?", state) and not left
    known = [r[0] for r in turns if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    kinds = [r[3] for r in turns]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return (gaps, *(kinds.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def broken(rng, n):
    return [(rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", " "]), rng.choice(["a.", "b!", "c", "", " \t", f"t{rng.randrange(40)}.", "é?\n"])) for _ in range(n)]


def test_every_short_lattice():
    """All conversations of up to four turns: the auction's distance and trace are the cheapest and the least."""
    for n in range(5):
        for initials in product("sua", repeat=n):
            for kinds in product((auction.SOUND, auction.BLANK, auction.TRUNCATED), repeat=n):
                lattice = auction.Lattice(list(initials), list(kinds))
                _, labels = lattice.trace(auction.START)
                assert (lattice.distance(auction.START), labels) == cheapest(initials, kinds)


def test_pieces_compose():
    """Prices that cross pieces give the costs of the whole, and their traces its audit."""
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 14)
        initials, kinds = [rng.choice("suax") for _ in range(n)], [rng.randrange(4) for _ in range(n)]
        size = rng.randrange(1, 5)
        cuts = [(initials[i : i + size], kinds[i : i + size], i + size >= n) for i in range(0, n, size)]
        prices, behind = list(auction.END), []
        for i, k, last in reversed(cuts):
            behind.append(prices)
            prices = auction.before(auction.matrix(i, k, last), prices)
        state, labels = auction.START, ""
        for (i, k, last), exits in zip(cuts, reversed(behind), strict=True):
            state, own = auction.Lattice(i, k, tuple(exits), last).trace(state)
            labels += own
        assert (prices[auction.START], labels) == cheapest(initials, kinds)


def test_prices_end_where_no_way_leads():
    got = auction.matrix(["a", "s", "u"], [auction.SOUND] * 3, False)
    assert [x >= auction.NEVER for x in got] == [False, False, False, False, True, False, False, False, True, True, False, False, True, True, False, False]


@pytest.mark.parametrize("piece", [conversations.PIECE, 3])
def test_audits_match_brute_force(spark, piece):
    rng = random.Random(7)
    convs = {c: broken(rng, rng.choice((1, 2, 5, 9, 30))) for c in range(30)}
    convs[100] = broken(rng, 400)
    data = [(c, *r) for c, rows in convs.items() for r in rows]
    rng.shuffle(data)
    rows = conversations.turns(frame(spark, data)).repartition(5)
    got = {int(r.conv): tuple(r)[1:] for r in conversations.audit(rows, piece).collect()}
    assert got == {c: expected(rows)[0] for c, rows in convs.items()}
    texts = {}
    for r in sorted(conversations.repaired(rows, piece).collect(), key=lambda r: (r.conv, r.position)):
        texts.setdefault(int(r.conv), []).append(f"{r.role}:{r.text}")
        assert (r.edit == "I") <= (r.text == "" and r.turn is None)
    assert texts == {c: expected(rows)[1] for c, rows in convs.items() if expected(rows)[1]}


def test_many_copies_of_one_turn(spark):
    """Equal rows are counted before they move, and stand for as many turns."""
    rows = [(1, 0, "user", "hello.")] * 500 + [(1, 1, "assistant", "yes.")]
    got = conversations.audit(conversations.turns(frame(spark, rows))).collect()
    assert [tuple(r)[1:] for r in got] == [expected([r[1:] for r in rows])[0]]


def test_digest_of_damaged_rows(spark):
    rng = random.Random(11)
    data = [(c, *r) for c in [*range(40), None] for r in broken(rng, 6)]
    want = {}
    for c in {r[0] for r in data}:
        rows = []
        for conv, turn, role, text in data:
            d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if conv == c and d:
                text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
                rows += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        want[c] = expected(rows)[0] if rows else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert {r.conv_id: tuple(r)[1:] for r in conversations.digest(frame(spark, data)).collect()} == want


def test_edges(spark):
    assert conversations.digest(frame(spark, [])).count() == 0
    # crc32 of "26:1" leaves 0 by 20: its one row is dropped, and the conversation stays.
    gone = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = conversations.digest(frame(spark, [(*gone, None, None), (gone[0] + 1000, None, None, None)])).collect()
    assert {r.conv_id: (r.audit, r.cost) for r in rows}[gone[0]] == ("", 0) and len(rows) == 2
    long = "word " * 200_000 + "end."
    got = conversations.audit(conversations.turns(frame(spark, [(1, 1, "user", long), (1, 2, "assistant", long)]))).collect()
    assert [r.audit for r in got] == ["KK"]


def test_query_matches_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    got = queries.QUERIES["op12_conversation_repair"](spark, data)
    want = con.execute(queries.ORACLE_SQL["op12_conversation_repair"])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
