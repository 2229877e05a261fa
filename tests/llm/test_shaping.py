"""Mixing, chat formatting, fingerprints, token counts, SentencePiece."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from faultline.llm import chat_format, curriculum, sentence_piece, syncmers, token_count
from faultline.llm.common import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def refill(sizes):
    """Targets by resharing the excess until no source is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if share * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {**fixed, **{s: share * weight[s] for s in free}}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_targets_by_refilling(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 30):
        sizes = {(None if k == n - 1 else f"s{k:02d}"): rng.choice([0, 5, 50, 1000, 20000]) for k in range(n)}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in curriculum.source_targets(table).collect()}
        want = refill(sizes)
        assert got == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_mix_report_meets_targets(hard, empty):
    rows = curriculum.mix_report(hard).collect()
    assert len(rows) == hard.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and (r.position is None) == (r.taken == 0)
        key = (r.source_size, r.target)
        by[key] = by.get(key, 0) + r.taken
    assert all(abs(taken - target) <= 1 for (_, target), taken in by.items())
    assert [r.position for r in rows if r.position is not None] == sorted(r.position for r in rows if r.position is not None)
    assert rows == curriculum.mix_report(hard).collect()
    assert curriculum.mix_report(empty).count() == 0 and curriculum.mix(empty).count() == 0


def test_mixed_texts_hold_the_words_taken(hard):
    mixed = curriculum.mix(hard)
    assert mixed.columns == hard.columns
    taken = curriculum.mix_report(hard).groupBy().agg(F.sum("taken")).first()[0]
    words = [len(WORD.findall(r.text)) for r in mixed.collect()]
    assert sum(words) == taken
    texts = {r.text for r in hard.collect() if r.text}
    assert all(any(t.startswith(r.text) for t in texts) for r in mixed.collect())


def test_position_inverts_the_schedule(spark):
    rows = spark.range(101).select(
        curriculum.position(F.col("id") * 10, F.lit(1000), F.lit(0)).alias("x"), F.col("id")).collect()
    a, b = curriculum.SCHEDULES[0]
    for r in rows:
        asked = (a * r.x + (b - a) * r.x**2 / 2) / ((a + b) / 2)
        assert asked == pytest.approx(r.id / 100, abs=1e-9)


TURNS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a\\</s>\\\\[/INST] <s> é"), (1, 2, "user", "ends \\"),
    (1, 3, "assistant", ""), (1, 4, "assistant", "again\n"), (1, 5, "tool[TEXT]", " [/TEXT] [ROLE] x"), (2, 0, None, None),
    (3, 0, "system", "<<SYS>> \\<</SYS>>"), (3, 1, "user", "x"), (3, 1, "user", "x"), (3, None, "assistant", "first"),
    (None, 0, "assistant", "lone"), (4, 0, "user", "\\" * 50_000 + "[INST]"), (4, 1, "assistant", "y [INST" + "INST] " * 9),
]


def test_conversations_read_back(spark):
    from collections import defaultdict

    want = defaultdict(list)
    for conv, turn, role, text in TURNS:
        want[conv].append((-1 if turn is None else turn, role or "", text or ""))
    table = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, lead string")
    examples = chat_format.expand(table).cache()
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns.sort()
        r = got[conv]
        flat = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(flat.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.expand(table.limit(0)).count() == 0


def test_every_reply_is_an_example_with_all_turns_before(spark):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    rows = chat_format.with_context(chat_format.expand(table)).filter("conv_id = 1").orderBy("example")
    rows = rows.select("example", "target", chat_format.parse_turns(F.regexp_replace("context", "<s> $", "")).alias("turns")).collect()
    assert [r.example for r in rows] == [0, 1, 2]
    assert [[t.text for t in r.turns] for r in rows] == [[t[3] for t in TURNS[:k]] for k in (1, 3, 4)]


def test_examples_hold_their_whole_prefix(spark):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    examples = chat_format.expand(table).cache()
    written = chat_format.prefix_targets(examples).cache()
    whole = {(r.conv_id, r.example): r.context for r in chat_format.with_context(examples).collect()}
    assert {(r.conv_id, r.example): r.prefix for r in written.filter("target IS NOT NULL").collect()} == whole
    read, back = (sorted(map(str, f(d).collect())) for f, d in (
        (chat_format.read_prefixes, written), (chat_format.read_back, examples)))
    assert read == back
    # What is read stands in the prefixes: without them there is less to read.
    cut = written.withColumn("prefix", F.substring("prefix", 1, 0))
    assert sorted(map(str, chat_format.read_prefixes(cut).collect())) != back


def test_places_are_those_in_the_shared_text(spark):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    examples = chat_format.expand(table)
    texts = {r.conv_id: r for r in chat_format.shared_texts(examples).collect()}
    for r in examples.collect():
        whole = texts[r.conv_id].formatted
        assert whole[r.start_chars :].startswith(r.lead)
        if r.target is not None:
            assert whole[r.loss_start - 1 : r.loss_start - 1 + r.loss_chars] == r.target
            assert whole[: r.context_chars] + "<s> " == whole[: r.loss_start - 1]


def test_long_conversations_take_linear_time(spark):
    def seconds(n):
        rows = spark.range(n).select(
            F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
            F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("some words [INST] " * 6).alias("text"))
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        start = time.perf_counter()
        got = chat_format.read_back(chat_format.expand(rows)).first()
        assert got.n_turns == n and got.loss_chars == n // 2 * 108
        return time.perf_counter() - start

    seconds(500)
    assert seconds(8000) < 2.5 * min(seconds(4000), seconds(4000)) + 1


def test_syncmers_by_brute_force(spark, given):
    from pyspark.sql.functions import xxhash64

    rows = given.limit(40).select("text", syncmers.anchors(F.col("text")).alias("found")).collect()
    tokens = [re.findall(r"[^\x20\x09-\x0D]{1,4}", r.text) for r in rows]
    flat = spark.createDataFrame([(t,) for t in sorted({t for ts in tokens for t in ts})], "t string")
    h = {r.t: r.h for r in flat.select("t", xxhash64("t").alias("h")).collect()}
    for r, ts in zip(rows, tokens):
        hs = [h[t] for t in ts]
        pairs = spark.createDataFrame(list(zip(range(len(hs)), hs, hs[1:])), "i int, a long, b long") if len(hs) > 1 else None
        if r is not rows[0] and r is not rows[7]:
            continue  # one Spark job each; two texts are enough
        g = [x.g for x in pairs.select("i", xxhash64("a", "b").alias("g")).orderBy("i").collect()]
        want = [i for i in range(len(hs) - 4) if min(g[i : i + 4]) in (g[i], g[i + 3])]
        assert [a.at for a in r.found] == want


def test_fingerprints_on_hard_rows(hard, empty):
    rows = sorted(hard.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(syncmers.fingerprint_documents(hard).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    texts = [r.text or "" for r in rows]
    prints = {}
    for k, (r, t) in enumerate(zip(got, texts)):
        after = texts[(k + 1) % len(texts)]
        half = len(t) // 2
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest(), r.doc_id
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[10].near_next == 1.0 and by_id[11].near_next > 0.9  # the same long text, then with one word more
    assert syncmers.fingerprint_documents(empty).count() == 0


def test_next_document_across_ranges(spark, given):
    rows = syncmers.fingerprint_documents(given.repartition(5)).collect()
    texts = [r.text for r in given.orderBy("doc_id").collect()]
    want = {}
    for k, t in enumerate(texts):
        half = len(t) // 2
        want[k] = hashlib.sha256((t[: len(t) - half] + texts[(k + 1) % len(texts)][:half]).encode()).hexdigest()
    assert {r.doc_id: r.edited_sha256 for r in rows} == want


def test_token_counts_match_the_library(hard, empty, given):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(token_count.VOCABULARY))
    for docs in (hard, given):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        for r in token_count.count_tokens(docs).collect():
            if r.doc_id is not None:
                assert r.n_tokens == len(t.encode(texts[r.doc_id], add_special_tokens=False).ids), r.doc_id
                assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048)
    assert token_count.count_tokens(empty).count() == 0


def test_token_counts_of_odd_strings():
    from tokenizers import Tokenizer

    path = tokenizer_file(token_count.VOCABULARY)
    t, count = Tokenizer.from_file(path), token_count.token_counter(path, token_count.proven_whole(path))
    rng = random.Random(2)
    odd = [*map(chr, range(0x300)), *"İΣσςß ﬁ①²½ǅ\u0301\u0345ẞ𝔸😀漢한\u200b\u2028\u1680", "<|endoftext|>", "'s", "'LL", " "]
    for _ in range(4000):
        s = "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))
        assert count(s) == len(t.encode(s, add_special_tokens=False).ids), repr(s)


def test_pieces_match_the_library():
    import sentencepiece

    path = tokenizer_file(sentence_piece.MODEL)
    codec, library = sentence_piece.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    words = [library.id_to_piece(i) for i in range(259, 32000)]
    for k in range(6000):
        if k % 2:
            s = "".join(rng.choice(words) for _ in range(rng.randint(0, 8))).replace("▁", rng.choice([" ", "▁"]))
        else:
            s = "".join(rng.choice(["ab", " ", "  ", "é", "漢", "😀", "\x00", "the", " re", "a", "-----", "\n"]) for _ in range(rng.randint(0, 25)))
        ids = library.encode(s)
        assert codec.encode(s) == ids and codec.decode(ids) == library.decode(ids), repr(s)


@pytest.mark.parametrize("text", ["ab" * 20_000, "x" * 30_000, "nonono" * 5_000 + "é" * 100, "=" * 5000, "thereononin" * 4000])
def test_pieces_of_long_runs_are_streamed(text):
    import sentencepiece

    path = tokenizer_file(sentence_piece.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = sentence_piece.Codec(path)
    assert codec.encode(text) == library.encode(text)
    read = []

    class Counted(str):
        """A text that notes how far it was read when each piece came out."""

        def __getitem__(self, at):
            if isinstance(at, int):
                read.append(at)
            return str.__getitem__(self, at)

    whole, done, ahead = text[:4000], 0, 0
    for piece in sentence_piece.stream_pieces(codec.pieces, Counted(whole)):
        if read[-1] + 1 < len(whole):
            ahead = max(ahead, read[-1] - done)
        done += len(piece)
    assert done == len(whole) and ahead <= 6 * codec.pieces.longest


def test_short_texts_have_the_pieces_of_the_stream(given):
    pieces = sentence_piece.Codec(tokenizer_file(sentence_piece.MODEL)).pieces
    for r in given.limit(40).collect():
        words = {w for w in re.split("[\\s.,]+", r.text)} - {""}
        for word in {w[: 4 * pieces.longest] for w in words}:
            assert sentence_piece.window_pieces(pieces, "▁" + word) == list(sentence_piece.stream_pieces(pieces, "▁" + word))


def test_a_long_unspaced_text_takes_linear_time():
    import sentencepiece

    path = tokenizer_file(sentence_piece.MODEL)
    rng = random.Random(8)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1_000_000))
    codec = sentence_piece.Codec(path)
    start = time.perf_counter()
    ids = codec.encode(text)
    assert time.perf_counter() - start < 20
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert ids[:100_000] == library.encode(text[:60_000])[:100_000] or codec.encode(text[:60_000]) == library.encode(text[:60_000])
    assert codec.decode(ids) == text


def test_encoding_of_hard_rows(hard, empty):
    texts = {r.doc_id: r.text or "" for r in hard.collect()}
    for r in sentence_piece.encode_documents(hard).collect():
        assert r.n_ids == len(r.ids) and r.round_trip == ("▁" not in texts.get(r.doc_id, ""))
    assert sentence_piece.encode_documents(empty).count() == 0
