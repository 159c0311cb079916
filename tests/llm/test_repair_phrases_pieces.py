"""Conversation repair, phrase mining and the piece table against brute force and the public library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import count

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import functions as F

from auditlens import session
from auditlens.llm import conversations, phrases, piece_table, queries
from auditlens.llm.tries import PhraseTrie

PIECES = public_tokenizers.path(queries.PIECES)
EMPTY = hashlib.sha256().hexdigest()


# Conversations


def least_repair(rows):
    """All edits tried from every state: counts, cost, least audit and digest of the (role, text) rows."""
    seen, faults = set(), []
    for row in rows:
        body = row[1].rstrip(conversations.BLANKS)
        faults.append("blank" if not body else "duplicate" if row in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add(row)
    initials = [r[0][:1] for r in rows]
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @cache
    def best(i, q, inserted):
        found = []
        if i == len(rows):
            if q in ("", "a"):
                found.append((0, "", ()))
        else:
            cost, letters, rest = best(i + 1, q, 0)
            found.append((cost + 4, "D" + letters, rest))
            if faults[i] in ("", "truncated"):
                cut = 3 if faults[i] else 0
                kind = initials[i]
                if (kind, q) in {("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")}:
                    cost, letters, rest = best(i + 1, kind, 0)
                    found.append((cost + cut, "K" + letters, (":".join(rows[i]), rest)))
                cost, letters, rest = best(i + 1, follows[q], 0)
                found.append((cost + cut + 3, "R" + letters, (f"{names[follows[q]]}:{rows[i][1]}", rest)))
        if inserted < 3:
            cost, letters, rest = best(i, follows[q], inserted + 1)
            found.append((cost + 3, "I" + letters, (f"{names[follows[q]]}:", rest)))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    # From the back, so that the recursion stays shallow.
    for i in range(len(rows), -1, -1):
        for q in ("a", "u", "s", ""):
            best(i, q, 0)
    cost, letters, rest = best(0, "", 0)
    lines = []
    while rest:
        lines.append(rest[0])
        rest = rest[1]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (*counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected_reports(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        text = "" if fate == 1 else text.translate({ord(c): None for c in ".?!"}) if fate == 2 else text
        kept[conv] += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    for conv, turns in kept.items():
        if not turns:
            yield conv, (0, 0, 0, 0, 0, 0, "", EMPTY)
            continue
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        known = {t[0] for t in turns} - {None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        yield conv, (gaps, *least_repair([t[1:] for t in turns]))


def op11_rows(seed):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "uz", "", None, "tool"]
    texts = ["a.", "b", "c?", " ", "hi!", None, "", "\t\n", "end. \n"]
    rows = []
    for conv in [None, *range(30)]:
        rows += [(conv, t, draw.choice(roles), draw.choice([*texts, f"x{t}.", f"y{t}"])) for t in range(draw.randint(1, 12))]
    rows += [(40, t, draw.choice(["tool", "x"]), f"q{t}." if draw.random() < 0.8 else f"w{t}") for t in range(300)]
    rows += [(41, t, ["user", "assistant"][t % 2], f"q{t}.") for t in range(300)]
    rows += [(42, None if t < 3 else t, draw.choice(["user", "assistant"]), draw.choice(["same.", f"q{t}."])) for t in range(300)]
    rows += [(43, t, "user", "the same.") for t in range(300)] + [(44, 7, "user", "the same.")] * 60
    return rows + [(45, None, "user", "no turn."), (46, 1, "user", "long " * 30_000)]


@pytest.mark.parametrize("partitions", [1, 13])
def test_repairs_are_the_least_of_all(spark, tmp_path, partitions):
    rows = op11_rows(partitions)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = queries.op11_viterbi_repair(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r.conv_id: tuple(r[n] for n in names) for r in got} == dict(expected_reports(rows))
    assert len(got) == len({r[0] for r in rows})


def test_fix_up_stops_where_vectors_agree():
    draw = random.Random(2)
    codes = bytes(draw.randrange(8) for _ in range(500))
    for end in ((0, 1, 3, 0), (3, 3, 0, 3)):
        trail = conversations.Steps().run_back(codes, conversations.AT_END)
        steps = conversations.Steps()
        reads = []
        plain = steps.back
        steps.back = lambda v, c: (reads.append(1), plain(v, c))[1]
        assert steps.start_of(codes, end, trail) == conversations.Steps().run_back(codes, end)[0]
        assert len(reads) < 100


def test_repaired_turns_and_clashing_columns(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "user", "b."), (1, 2, "user", "c?"), (1, 3, "assistant", "d!")]
    names = ("pos", "kind", "fault", "digest", "conv", "edits", "at", "part", "positions", "codes")
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select(
        "*", *(F.lit("x").alias(n) for n in names)
    )
    repaired = conversations.repair_conversations(frame)
    lines = [r.line for r in conversations.repaired_turns(repaired).orderBy("pos", "place").collect()]
    # Deleting the first turn costs more than a user before it, and an answer between the users is needed.
    assert lines == ["user:", "assistant:a.", "user:b.", "assistant:", "user:c?", "assistant:d!"]
    edits = {r.text: r.edits for r in repaired.turns.collect()}
    assert edits == {"a.": "xK", "b.": "K", "c?": "yK", "d!": "K"}
    report = conversations.conversation_report(frame).first()
    assert report.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert conversations.conversation_report(frame.limit(0)).count() == 0


# Phrases


def mined(rows, longest, least, top, share=50):
    """(lang, rank, phrase, a, l, r, n, score) by plain counting."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for end in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(end, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        n = sum(c for p, c in f.items() if len(p) == 1)
        frequent = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        for p, a in frequent.items():
            inside = [
                c for q, c in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            ]
            if any(100 * c >= share * a for c in inside):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def phrase_rows(seed, n=300):
    draw = random.Random(seed)
    words = ["Ab", "ab", "çé", "x\x00y", "the", "of", "ÀB", "a" * 400, "\x1c", "q"] + [f"w{i}" for i in range(25)]
    rows = []
    for _ in range(n):
        parts = [draw.choice(words) for _ in range(draw.randint(0, 30))]
        if draw.random() < 0.3:
            parts += ["new", "york", "city"]
        gap = draw.choice([" ", "  ", "\t", ", ", ".\n", " \r\n "])
        rows.append((gap.join(parts), draw.choice(["en", "en", "de", None, "und", ""])))
    return [*rows, *rows[:20], (None, "en"), ("", None), ("  \t", "de"), ("the of " * 5000, "en"), ("ab " * 3000, "fr")]


@pytest.mark.parametrize("longest", [3, 4])
def test_phrases_equal_plain_counts(spark, longest):
    rows = phrase_rows(longest)
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    frame = frame.select("*", *(F.lit("x").alias(c) for c in ("id", "word", "w", "n", "f", "bucket", "rank", "_part")))
    got = phrases.collocations(frame, longest=longest, least=10, top=40)
    assert sorted(map(tuple, got.collect())) == mined(rows, longest, 10, 40)


def test_phrases_over_many_shards_and_passes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PHRASES_PER_TRIE", 25)
    monkeypatch.setattr(phrases, "TRIES_AT_ONCE", 2)
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 7)
    rows = phrase_rows(9)
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    got = phrases.collocations(frame, longest=4, least=6, top=1000)
    assert sorted(map(tuple, got.collect())) == mined(rows, 4, 6, 1000)


def test_phrase_passes_leave_nothing_behind(spark, monkeypatch, tmp_path):
    """Passes over the texts keep neither their copies of them nor their candidates and broadcasts."""
    made, gone, number = [], [], count()
    monkeypatch.setattr(phrases, "PHRASES_PER_TRIE", 25)
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(session, "scratch_path", lambda _, name: str(tmp_path / f"{name}-{next(number)}"))
    context, broadcast = type(spark.sparkContext), type(spark.sparkContext).broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: made.append(1) or broadcast(self, value))
    destroy = Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: gone.append(1) or destroy(self, *a))
    frame = spark.createDataFrame(phrase_rows(9), "text string, lang string").repartition(2)
    found = phrases.mine_phrases(frame, longest=3, least=6)
    kept = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert kept == {"phrases-totals", "phrases-frequent", "phrases-2", "phrases-3"} and found.phrases.count() > 0
    assert len(made) == len(gone) > 8


def test_more_tries_make_no_more_passes(spark, monkeypatch):
    """Candidates of many tries are counted where they are dealt; the texts are not read again for each trie."""
    monkeypatch.setattr(phrases, "PHRASES_PER_TRIE", 5)
    monkeypatch.setattr(phrases, "_DEALT_TOGETHER", 400)
    passes, plain = [], phrases._counted
    monkeypatch.setattr(phrases, "_counted", lambda *a: passes.append(1) or plain(*a))
    rows = phrase_rows(5)
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = phrases.collocations(frame, longest=3, least=6, top=1000)
    assert sorted(map(tuple, got.collect())) == mined(rows, 3, 6, 1000)
    assert len(passes) <= 2


@pytest.mark.parametrize("length", [2, 3])
def test_each_phrase_lies_in_the_shard_that_texts_look_for(spark, length):
    ids = np.random.default_rng(length).integers(2, 1 << 64, 500 + length, dtype=np.uint64)
    columns = phrases._columns(length)
    rows = [tuple(ids[i : i + length].view(np.int64).tolist()) for i in range(len(ids) - length + 1)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{c} long" for c in columns))
    told = dict(frame.select("i", phrases._shard(columns, 7)).collect())
    of = phrases._shards_of(ids, length, 7)
    assert [told[i] for i in range(len(rows))] == of.tolist() and set(of) == set(range(7))
    trie = PhraseTrie(np.array(rows, np.int64).view(np.uint64)[of == 3])
    assert trie.occurrences(ids, np.flatnonzero(of == 3))[0].tolist() == trie.occurrences(ids)[0].tolist()


def test_phrases_of_nothing(spark):
    frame = spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")
    assert phrases.collocations(frame).count() == 0
    assert phrases.collocations(frame.limit(0)).count() == 0


@pytest.mark.parametrize("length,n,words", [(1, 200, 500), (2, 5000, 900), (3, 5000, 60), (2, 1, 1)])
def test_trie_finds_all_occurrences(length, n, words):
    draw = np.random.default_rng(length * n)
    scale = np.uint64(0x9E3779B97F4A7C15)
    held = np.unique((draw.zipf(1.3, (n, length)) % words + 1).astype(np.uint64) * scale, axis=0)
    text = (draw.zipf(1.3, 20_000) % words).astype(np.uint64) * scale
    at, number = (trie := PhraseTrie(held)).occurrences(text)
    known, plain = set(map(tuple, held.tolist())), text.tolist()
    want = [(i, tuple(plain[i : i + length])) for i in range(len(plain) - length + 1) if tuple(plain[i : i + length]) in known]
    assert list(zip(at.tolist(), map(tuple, trie.phrases[number].tolist()))) == want


def test_trimming_keeps_every_possible_phrase():
    draw = random.Random(1)
    for _ in range(200):
        ids = np.array([draw.randrange(1, 5) for _ in range(draw.randint(0, 30))], np.uint64)
        for length in (1, 2, 3):
            mark = np.array([draw.random() < 0.6 and i + length <= len(ids) for i in range(len(ids))], bool)
            kept = phrases.trimmed(ids, mark, length)
            at = phrases._safe_starts(kept, length + 1)
            got = sorted(tuple(kept[i : i + length + 1].tolist()) for i in at)
            want = sorted(
                tuple(ids[i : i + length + 1].tolist()) for i in range(len(ids) - length) if mark[i] and mark[i + 1]
            )
            assert got == want


# Pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    return piece_table.PieceModel(open(PIECES, "rb").read())


def piece_texts(model, seed, n):
    draw = random.Random(seed)
    names = [name for name in model.names if len(name) > 1]
    wide = [(0, 127), (128, 0x2FFF), (0x3000, 0xD7FF), (0xE000, 0x1FFFF)]
    for _ in range(n):
        yield "".join(draw.choice(names) for _ in range(draw.randint(1, 8)))
        yield "".join(draw.choice("ab cd eth  in\n\tr▁é日本ש²._") for _ in range(draw.randint(1, 40)))
        yield "".join(chr(draw.randint(*draw.choice(wide))) for _ in range(draw.randint(1, 30)))


FIXED_TEXTS = ["", " ", "  ", "▁", "▁▁ a", "\n", " \n", "\x00", "a" * 5000, " " * 3000, "x" + " " * 33 + "y", "<s></s><unk><0x0A>"]


def test_pieces_equal_the_library(model, library):
    for text in [*FIXED_TEXTS, *piece_texts(model, 3, 1500)]:
        ids = library.encode(text, add_eos=True)
        assert model.ids(text) == ids
        assert model.decoded(ids) == library.decode(ids)


def test_pieces_decode_any_ids(model, library):
    draw = random.Random(5)
    for _ in range(2000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(260), 28705]) for _ in range(draw.randint(0, 8))]
        assert model.decoded(ids) == library.decode(ids)


def test_last_pieces_are_those_of_every_prefix(model, library):
    """The table against encoding each prefix anew."""
    for word in ("▁unbelievable", "internationalization", "▁▁▁▁▁x", "aaaaaaaaaaaaa"):
        last = model.last_pieces(word)
        for end in range(1, len(word) + 1):
            assert model.stretch_ids(word[:end])[-1] == last[end]


def test_piece_operators(spark, documents, mixed_texts, library):
    frame = documents([*mixed_texts, None, "tail  "], clash=True)
    texts = {r.doc_id: r.text or "" for r in frame.collect()}
    encoded = piece_table.encode_texts(frame, PIECES)
    ids = {r.id: r.ids for r in encoded.collect()}
    assert ids == {k: library.encode(t, add_eos=True) for k, t in texts.items()}
    decoded = {r.id: r.text for r in piece_table.decode_ids(encoded, PIECES).collect()}
    assert decoded == {k: library.decode(v) for k, v in ids.items()}
    for r in piece_table.token_digests(frame, PIECES).collect():
        assert r.n_tokens == len(ids[r.id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids[r.id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded[r.id].encode()).hexdigest()
    assert piece_table.token_digests(frame.limit(0), PIECES).count() == 0


def test_op13_on_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op13_piece_table(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
