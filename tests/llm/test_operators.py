import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.llm import best_fit_packing, chat_format, common, fast_tokens, huffman_ids, language_id, quality_rules, secret_scan, sentencepiece_codec, toxicity, vector_links, weighted_dedup

SF = "/root/testdata/sf0.001"
LONG = "word number " * 3000
# null id, null text, empty, blank, no letters, very long, repeated rows, equal texts, a short text, odd characters
ROWS = [(None, "text without an id"), (1, None), (2, ""), (3, " \n\t "), (4, "1234 !!"), (5, LONG), (6, "same words in this row here"), (6, "same words in this row here"), (7, "same words in this row here"), (8, "a"), (9, "é 漢 😀 \x00 <|endoftext|> ▁ x")]


@pytest.fixture(scope="module")
def odd(spark):
    """Extra columns take the names that operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(0).alias("n_chars"), F.lit(1).alias("host"), F.lit(2).alias("id"), F.lit(3).alias("held_out"), F.lit(4).alias("task"), F.lit(5).alias("h1"), F.lit(6).alias("k"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return dict(docs.select("doc_id", "text").toPandas().itertuples(index=False))


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


BYTE, WORD, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
OPS = {
    "pack": lambda d: best_fit_packing.pack(d, BYTE),
    "ids": lambda d: huffman_ids.round_trip(d, WORD),
    "pieces": lambda d: sentencepiece_codec.encode_decode(d, PIECE),
    "language": lambda d: language_id.predict(d, language_id.samples(d)),
    "toxicity": lambda d: toxicity.predict(d, None),
    "toxicity learned": lambda d: toxicity.predict(d, small_machine()),
    "dedup": weighted_dedup.classes,
    "secrets": secret_scan.scan,
    "quality": quality_rules.rules,
}


def small_machine():
    return toxicity.train([(f"some words {i} here {'blockhead' if i % 4 == 0 else 'ahead'} and {i * 7} more", int(i % 4 == 0)) for i in range(80)])


@pytest.mark.parametrize("name", OPS)
def test_odd_and_empty_tables(odd, name):
    got = OPS[name](odd).toPandas()
    ids = got["doc_id"].astype("float") if name != "pack" else got.loc[got["piece"] == 0, "doc_id"].astype("float")
    assert sorted(ids.fillna(-1)) == sorted(float(i) if i is not None else -1 for i, _ in ROWS)
    assert OPS[name](odd.limit(0)).count() == 0
    if name == "toxicity learned":
        assert set(got["predicted"]) == {0} and got["score"].between(0, 1).all()
    if name == "dedup":
        classes = {r.doc_id: r.class_id for r in got.itertuples() if r.doc_id == r.doc_id}
        assert classes[7] == 6 and classes[1] == 1 and classes[2] == 2 and classes[3] == 3
    if name == "language":
        assert {r.doc_id: r.lang_pred for r in got.itertuples()}[4] == "und"


def test_fast_tokens_equal_the_library():
    r = random.Random(1)
    letters = list("ab c  \n\t.'s,9é ▁ñΣ́​漢😀\x00\x85\x1c\xa0½ªµ") + ["<|endoftext|>", "'ll", " the", "tion"]
    some = ["".join(r.choice(letters) for _ in range(r.randrange(50))) for _ in range(3000)] + [a + b + "x" for a in map(chr, range(0, 256, 3)) for b in map(chr, range(256))]
    for path in (BYTE, WORD):
        for fast in (True, False):
            own = fast_tokens.FastTokens(path, fast)
            want = [np.array(e.ids, "<u4").tobytes() for e in own.tok.encode_batch(some, add_special_tokens=False)]
            assert own.ids(some) == want


def test_guards_see_other_ids(monkeypatch):
    """A text whose quick ids or joined pieces differ from the library's stops the task."""
    own = fast_tokens.FastTokens(BYTE, True)
    own.to_id = own.to_id + np.uint32(1)
    with pytest.raises(ValueError, match="differ from the library"):
        own.ids(["plain text"])
    pieces = sentencepiece_codec.codec(PIECE)
    monkeypatch.setattr(pieces.table, "known", {"plain": ("5", 1, "plain"), "text": ("6", 1, "text")})
    with pytest.raises(ValueError, match="differ from the library"):
        list(pieces.digests(["plain text"]))
    monkeypatch.undo()
    pieces.table.known.clear()


def test_pack(docs, texts):
    got = best_fit_packing.pack(docs, BYTE).toPandas().sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id")
    assert (got["offset"] == by["length"].cumsum() - got["length"]).all() and by["length"].sum().max() <= 1024
    tok = tokenizer("byte_bpe_50k.json")
    for doc, own in got.sort_values("piece").groupby("doc_id"):
        ids = [*tok.encode(texts[doc], add_special_tokens=False).ids, 2]
        assert list(own["start"]) == list(own["length"].cumsum() - own["length"]) and own["length"].sum() == len(ids)
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c in zip(own["start"], own["length"], own["ids_crc32"], strict=True))
        assert len(own) == 1 or (own["length"].iloc[1:] == 1024).all()
    counts = got["length"].value_counts()
    assert got["sequence_id"].nunique() == decreasing(list(got["length"])) and counts.sum() == len(got)


def decreasing(lengths, size=1024):
    """Plain best-fit decreasing."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(size - n)
    return len(gaps)


def test_sweep_equals_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(60):
        lengths = [r.randint(1, r.choice([8, 64])) for _ in range(r.randrange(1, 300))]
        plan, bins = best_fit_packing.sweep(collections.Counter(lengths), 64)
        assert bins == decreasing(lengths, 64)
        fill = collections.defaultdict(list)
        for n, low, high, each, first, base in plan:
            for k in range(high - low):
                fill[first + k // each].append((base + k % each * n, n))
        assert sum(map(len, fill.values())) == len(lengths)
        for spots in fill.values():
            at = 0
            for offset, n in sorted(spots):
                assert offset == at
                at += n
            assert at <= 64


def test_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    near = base[rng.integers(0, 40, 500)] + rng.normal(size=(500, 16)) * 0.15
    all_ = np.vstack([base, near, base[:1].repeat(200, 0)]).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(all_)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, None] * 8), (5004, [1.0, 2.0]), (None, [1.0] * 16), (5005, [])]
    linked = vector_links.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).withColumn("n", F.lit(2)))
    got, audits = linked.toPandas(), linked._audits.toPandas()
    assert audits["links"].sum() > 1000 and audits["found"].sum() >= 0.98 * audits["links"].sum()
    assert vector_links.link(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    own = got.dropna(subset=["vec_id"]).set_index("vec_id")
    unit = all_.astype(float) / np.linalg.norm(all_.astype(float), axis=1, keepdims=True)
    true = unit @ unit.T >= 0.9
    np.fill_diagonal(true, False)
    found = own.loc[range(len(all_)), "n_links"].to_numpy()
    assert (found <= true.sum(1)).all() and found.sum() >= 0.98 * true.sum()
    label = np.arange(len(all_))
    for _ in range(30):
        label = np.minimum(label, np.where(true, label[None], 10**6).min(1))
    assert (own.loc[range(len(all_)), "component_id"].to_numpy() == label).mean() > 0.99
    assert (own.loc[[5000, 5001, 5002, 5003, 5004, 5005], "n_links"] == 0).all() and (own.loc[[5000, 5004], "kept"]).all() and len(got) == len(rows)


def test_an_audit_that_no_beam_passes_ends_in_comparing_all():
    """A graph whose links lead nowhere: the audit sees it, and the exact search loses no link."""
    rng = np.random.default_rng(43)
    base = rng.normal(size=(40, 8))
    vectors = np.vstack([base, base + rng.normal(size=base.shape) * 0.02]).astype(np.float32)
    unit, ids = vector_links.unit_of(vectors), np.arange(80)
    graph = vector_links.Graph(unit.astype(np.float32))
    for table in graph.near:
        table[:] = -1
    packed = vector_links.pack(ids, np.ones(80, np.int64), vectors, None)
    own, degree, a, b, links, found = vector_links.search_shard(packed, (ids, np.ones(80, np.int64), unit, graph), 0.9, 8, 16, 0.99)
    true = unit @ unit.T >= 0.9
    label = np.arange(80)
    for _ in range(80):
        label = np.minimum(label, np.where(true, label[None], 80).min(1))
    assert (degree == true.sum(1) - 1).all() and links == found > 0 and len(a) == 80 - len({*label.tolist()})
    probes = vector_links.planted(unit, 0.9, 16)
    assert len(probes) == 16 and ((probes @ unit.T.astype(np.float32)).max(1) >= 0.9).all()


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(50)] + [(400, 401 + i) for i in range(50)]
    got = {x.id: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k in linked}


def test_automaton_finds_substrings():
    r = random.Random(5)
    for _ in range(50):
        own = [r.randrange(1, 4) for _ in range(30)]
        table = language_id.automaton(own, 4)
        subs = {tuple(own[i:j]) for i in range(30) for j in range(i + 1, 31)}
        probe = [r.randrange(1, 4) for _ in range(60)]
        state, got, want, run = 0, 0, 0, ()
        for c in probe:
            entry = int(table[state + c])
            got, state = got + (entry >> 30), entry & language_id.BREAK - 1
            want, run = (want, (*run, c)) if (*run, c) in subs else (want + 1, (c,))
        assert got == want


def test_language(docs):
    got = language_id.predict(docs, language_id.samples(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) and (held["lang_pred"] == held["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_language_stage_without_a_language(odd):
    """Without any labelled row only null texts and texts without a letter go."""
    import corpus_pipeline

    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.languages(odd.sparkSession, bare, "").toPandas()
    assert sorted(got["text"]) == sorted(t for _, t in ROWS if t and any(c.isalpha() for c in t)) and list(got.columns) == bare.columns


def test_language_stage_acts_on_the_parse(docs):
    """A long text in a script or of letter pairs that no learned language has goes; what is in a learned one stays, and a null lang is filled."""
    spark = docs.sparkSession
    model = language_id.samples(docs)
    r = random.Random(41)
    strange = ["漢字仮名交じり文" * 40, "".join(r.choice("xqzjvkwž ") for _ in range(600))]
    rows = [(9001, strange[0], "en"), (9002, strange[1], None), (9003, strange[1][:40], None)]
    both = docs.select("doc_id", "text", "lang").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {x.doc_id: x.lang for x in language_id.keep_known(both, model).collect()}
    true = {x.doc_id: x.lang for x in docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang").collect()}
    assert got.keys() == true.keys() | {9003} and sum(got[k] == v for k, v in true.items()) >= 0.97 * len(true)


STAGE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    """Null ids and texts, empty and very long texts, equal rows, and further columns with names that the operators use."""
    import corpus_pipeline

    odd = spark.createDataFrame([(i, t, "en" if k % 2 else None, None, len(t or "")) for k, (i, t) in enumerate(ROWS)], STAGE_COLUMNS)
    odd = odd.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("host", "id", "held_out", "task", "h1", "k", "score", "toxic", "length", "rep"))))
    spark.createDataFrame([(4, 0, 0), (6, 0, 1), (8, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    lettered = sorted(((i, t) for i, t in ROWS if t and any(c.isalpha() for c in t)), key=str)
    want = {
        "language_id": lettered, "secret_scan": sorted(ROWS, key=str), "toxicity": None,
        # null ids stay, of equal texts and rows the least id
        "minhash_near_dedup": sorted([(None, ROWS[0][1]), (1, None), (2, ""), (3, ROWS[3][1]), (4, ROWS[4][1]), (5, LONG), (6, ROWS[6][1]), (8, "a"), (9, ROWS[10][1])], key=str),
    }
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, odd, str(tmp_path)), stage(spark, odd.limit(0), str(tmp_path))
        assert none.count() == 0
        if name == "best_fit_packing":
            assert out.where("piece = 0").count() == len(ROWS)
            continue
        assert out.columns == odd.columns
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        if want[name] is not None:
            assert got == want[name], name
        else:
            assert {*got} <= {*ROWS} and (2, "") in got and (1, None) in got


def test_pieces(docs, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    r = random.Random(6)
    some = ["".join(r.choice(list("ab  \n.é▁漢😀\x00") + ["</s>", "the"]) for _ in range(r.randrange(30))) for _ in range(2000)]
    for text, (n, ids, said) in zip(some, sentencepiece_codec.codec(PIECE).digests(some), strict=True):
        want = model.encode(text, add_eos=True)
        assert (n, ids, said) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(model.decode(want).encode()).hexdigest())
    own = sentencepiece_codec.codec(PIECE)
    assert not own.whole and own.decode(own.ids("plain text")) == "plain text"


def test_toxicity(spark, docs):
    r = random.Random(7)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(400):
        own = [r.choice(words) for _ in range(30)]
        if i % 4 == 0:
            own[r.randrange(30)] = r.choice(["blockhead", "numbskull", "dimwit"])
        rows.append((" ".join(own), int(i % 4 == 0)))
    machine = toxicity.train(rows[:300])
    got = toxicity.scores([t for t, _ in rows[300:]], machine)
    assert all((s >= 0.3) == bool(y) for s, (_, y) in zip(got, rows[300:], strict=True))
    hidden = toxicity.scores([f"{words[0]} b.l.o.c.k.h.e.a.d {words[1]}", f"{words[0]} blockxhead {words[1]}", " ".join(words[:20]), ""], machine)
    assert (hidden >= 0.3).tolist() == [True, True, False, False]
    assert toxicity.train([("a b", 0)]) is None


def test_toxicity_of_words_that_never_stand_alone():
    """An insult always beside a stronger one is learned; what merely stands in copies of one toxic document is not, nor is a clean stem."""
    r = random.Random(13)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 7))) for _ in range(400)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    rows = [(" ".join([*some(15), "blockhead", *some(6), *(["vermyx"] if i % 2 else []), *some(9)]), 1) for i in range(60)]
    rows += [("zzopharb quietly " + "blockhead " + " ".join(words[:20]), 1)] * 20
    rows += [(" ".join([*some(30), *(["block"] if i % 5 == 0 else [])]), 0) for i in range(300)]
    machine = toxicity.train(rows)
    got = toxicity.scores([f"{a} {w} {b}" for a, b in (some(2),) for w in ("vermyx", "blockhead", "zzopharb", "block")], machine)
    assert (got >= 0.3).tolist() == [True, True, False, False]


@pytest.mark.parametrize("insult", ["混蛋家伙", "바보멍청이", "ばかやろう", "ｉｄｉｏｔ", "🤬🖕🤬"])
def test_toxicity_beyond_the_table_of_blanks(insult):
    """Code points from U+3000 up are letters of words, in training and in scoring."""
    r = random.Random(17)
    words = ["".join(r.choice("的一是不了人我在有他这中大来上国") for _ in range(r.randint(2, 5))) for _ in range(300)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    machine = toxicity.train([(" ".join([*some(12), *([insult] if i % 4 == 0 else []), *some(12)]), int(i % 4 == 0)) for i in range(400)])
    got = toxicity.scores([" ".join([*some(5), insult, *some(5)]), "\u3000".join([*some(5), insult]), " ".join(some(11))], machine)
    assert (got >= 0.3).tolist() == [True, True, False]


def test_samples_count_texts_not_copies(spark):
    """However many copies of a text stand first by hash, the bounds of both training samples count distinct texts."""
    texts = [f"text number {i} of the sample" for i in range(12)]
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    texts.sort(key=hashes.get)
    rows = [(i, t) for i, t in enumerate([*[texts[0]] * 200, *[texts[1]] * 200, *texts[2:] * 8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = docs.select("doc_id", F.when(F.col("text").isin(texts[::2]), 1).otherwise(0).alias("toxic"))
    assert toxicity.examples(docs, labels, toxic=4, clean=3) == sorted([*((t, 1) for t in texts[:8:2]), *((t, 0) for t in texts[1:6:2])])
    assert language_id.samples(docs, docs_each=5) == {"en": " ".join(texts[:5])}
    one = labels.where("doc_id < 200").select("doc_id", (F.col("doc_id") == 150).cast("int").alias("toxic"))
    assert toxicity.examples(docs, one) == [(texts[0], 1)]  # any copy's label counts
    assert language_id.samples(docs.withColumn("doc_id", F.lit(None).cast("long")), docs_each=5) == {"en": " ".join(texts[:5])}


def test_toxicity_of_words_spelt_with_spaces():
    """A learned insult is found with a space between its characters; one only ever spelt so is learned; a run ends with its text."""
    r = random.Random(23)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 7))) for _ in range(300)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    rows = [(" ".join([*some(12), *([["blockhead", "v e r m y x"][i // 4 % 2]] if i % 4 == 0 else []), *some(12)]), int(i % 4 == 0)) for i in range(400)]
    machine = toxicity.train(rows)
    texts = [" ".join([*some(5), w, *some(5)]) for w in ("b l o c k h e a d", "v e r m y x", "vermyx", "b. l. o. c. k. h. e. a. d", "q u i e t l y")]
    assert (toxicity.scores(texts, machine) >= 0.3).tolist() == [True, True, True, True, False]
    chars, offsets = common.code_points(["so a b", "c d so", "e f g"])
    starts, lengths, _, bounds = common.words(chars, offsets)
    text, own, at, many = toxicity.spelt(chars, starts, lengths, bounds)
    assert text.tolist() == [2] and "".join(map(chr, own[at[0] : at[0] + many[0]])) == "efg"
    assert toxicity.own_words("I a m ok a b") == ["iam", "i", "a", "m", "ok", "a", "b"]


def test_toxicity_learns_from_whole_texts(spark):
    """An insult that stands behind the first 8,000 characters of every labelled document is learned."""
    r = random.Random(19)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 7))) for _ in range(400)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    rows = [(i, " ".join([*some(1600), *(["blockhead"] if i % 4 == 0 else []), *some(9)])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all("blockhead" not in t[:8000] for _, t in rows)
    machine = toxicity.train(toxicity.examples(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))))
    got = toxicity.scores([" ".join([*some(5), "blockhead", *some(5)]), " ".join(some(11))], machine)
    assert (got >= 0.3).tolist() == [True, False]


def subsequences(word):
    """All subsequences of three and four characters within a span of five, the word's ends marked, weighted by their gaps."""
    marked, out = ["^", *word, "$"], collections.Counter()
    for n in (3, 4):
        for places in itertools.combinations(range(len(marked)), n):
            if places[-1] - places[0] <= 4:
                out["".join("\0" if marked[i] in "^$" and i in (0, len(marked) - 1) else marked[i] for i in places)] += toxicity.DECAY ** (places[-1] - places[0] - n + 1)
    return out


def test_kernel_against_brute_force():
    own, marks = ["idiot", "idxiot", "iidiot", "a", "ab", "parliament", "trash", "clé", "漢字"], ["idiot", "trash", "ab"]
    dot = lambda x, y: sum(v * y[k] for k, v in x.items())
    want = [[dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) for b in map(subsequences, marks)] for a in map(subsequences, own)]
    assert np.allclose(toxicity.kernel(own, marks), want, atol=1e-5)
    machine = small_machine()  # the folded machine gives what the kernel's expansion gives: equal words, equal values; no shared feature, the bias
    assert machine.words(*toxicity.spell(["漢字漢"]))[0] == pytest.approx(machine.bias)


def labelled(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, docs.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").where("text is not null").withColumn("held_out", common.held_out())


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.6), ("sf0.1", 0.8)])
def test_toxicity_held_out(spark, sf, least):
    """On rows never learned from most toxic documents are found and most clean ones left alone; sf0.01 has 37 toxic rows to learn from and 14 to judge by."""
    docs, labels, all_ = labelled(spark, sf)
    got = toxicity.predict(docs, toxicity.train(toxicity.examples(docs, labels))).join(all_.where("held_out").select("doc_id", "toxic"), "doc_id").toPandas()
    toxic, clean = got[got["toxic"] == 1], got[got["toxic"] == 0]
    print(sf, "found", toxic["predicted"].sum(), "of", len(toxic), "flagged", clean["predicted"].sum(), "of", len(clean))
    assert len(toxic) and toxic["predicted"].mean() >= least and clean["predicted"].mean() <= 0.05


def test_bent_insults_are_found_where_a_word_list_fails(spark):
    """Learned insults of the training rows with a letter put in or doubled, spelt with spaces or dots or cut in two, alone in clean texts; words
    of clean texts near to insults stay clean."""
    _, _, all_ = labelled(spark, "sf0.01")
    rows = [(r.text, r.toxic) for r in all_.where("not held_out").orderBy("doc_id").collect()]
    fit = [r for r in rows if zlib.crc32(r[0].encode()) % 3]
    machine = toxicity.train(fit)
    in_clean = {w for t, y in rows if not y for w in toxicity.own_words(t)}
    often = collections.Counter(w for t, y in fit if y for w in {*toxicity.own_words(t)})
    insults = [w for w, n in often.most_common() if n >= 5 and len(w) > 3 and w not in in_clean]
    hosts = [t for t, y in rows if not y and 60 < len(t) < 900 and not zlib.crc32(t.encode()) % 3][:10]
    r, letters = random.Random(29), "abcdefghijklmnopqrstuvwxyz"
    bend = {
        "put in": lambda w, i: w[:i] + r.choice(letters) + w[i:], "doubled": lambda w, i: w[:i] + w[i] + w[i:], "spaces": lambda w, i: " ".join(w),
        "dots": lambda w, i: ".".join(w), "halves": lambda w, i: w[:i] + " " + w[i:],
    }
    assert len(insults) >= 5 and hosts and (toxicity.scores(hosts, machine) < 0.3).mean() >= 0.9
    clean = [h for h, s in zip(hosts, toxicity.scores(hosts, machine), strict=True) if s < 0.3]
    for how, f in bend.items():
        texts = [f"{h} {f(w, r.randrange(1, len(w)))} {clean[0]}" for h in clean for w in insults]
        assert (toxicity.scores(texts, machine) >= 0.3).mean() >= 0.9, how
        # a list of whole words would find none of the first two kinds
        assert how not in ("put in", "doubled") or not any({*insults} & {*toxicity.own_words(t)} for t in texts)
    near = [w for w in sorted(in_clean) if any(len(set(zip(w, w[1:])) & set(zip(i, i[1:]))) >= 2 for i in insults)][:300]
    assert len(near) >= 20 and (toxicity.scores(near, machine) < 0.3).mean() >= 0.9


def test_ids(docs, texts):
    got = huffman_ids.round_trip(docs, WORD).toPandas().sort_values("doc_id")
    tok, at = tokenizer("word_bpe_49k.json"), 0
    for r in got.itertuples():
        ids = [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("limit", [8, 18])
def test_code(limit):
    rng = np.random.default_rng(8)
    for counts in (np.array([5]), np.array([0, 3, 0]), 2 ** np.arange(30), rng.integers(0, 100, 200), np.ones(256, int)):
        lengths = huffman_ids.code_lengths(counts, limit)
        used = lengths[lengths > 0].astype(int)
        assert ((lengths > 0) == (counts > 0)).all() and used.max() <= limit and (2.0**-used).sum() <= 1
        codes = huffman_ids.canonical(lengths)
        ids = rng.choice(np.flatnonzero(counts), 5000)
        payload = huffman_ids.encode(ids, lengths, codes, 64)
        assert (huffman_ids.decode(payload, huffman_ids.decoding_table(lengths, codes, limit), limit) == ids).all()


def test_code_lengths_are_optimal():
    """Against all length vectors of small alphabets, and against Huffman's cost where the limit does not bind."""
    import heapq

    r = random.Random(47)
    for _ in range(40):
        n, limit = r.randint(2, 6), r.randint(3, 4)
        counts = np.array([r.choice([1, 2, 3, 10, 100, 1000]) for _ in range(n)])
        best = min(sum(c * x for c, x in zip(counts.tolist(), ls, strict=True)) for ls in itertools.product(range(1, limit + 1), repeat=n) if sum(2.0**-x for x in ls) <= 1)
        assert int((counts * huffman_ids.code_lengths(counts, limit)).sum()) == best
    counts = np.array([r.randrange(1, 1000) for _ in range(300)])
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((counts * huffman_ids.code_lengths(counts, 40)).sum()) == cost


def shingle_bag(text):
    w = text.split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (collections.Counter([tuple(w)]) if w else collections.Counter())


def test_dedup(docs, texts):
    got = {r.doc_id: r.class_id for r in weighted_dedup.classes(docs).collect()}
    bags = {k: shingle_bag(t) for k, t in texts.items()}
    df = collections.Counter(s for b in bags.values() for s in b)
    n = sum(bool(b) for b in bags.values())
    weight = lambda s: 1 + weighted_dedup.DAMPED * math.log(n / max(df[s], n / 200)) / math.log(200)
    label = {k: k for k in bags}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in bags:
        for b in bags:
            if a < b and bags[a].keys() & bags[b].keys():
                both = bags[a].keys() | bags[b].keys()
                if sum(min(bags[a][s], bags[b][s]) * weight(s) for s in both) >= 0.8 * sum(max(bags[a][s], bags[b][s]) * weight(s) for s in both):
                    x, y = root(a), root(b)
                    label[max(x, y)] = min(x, y)
    assert got == {k: root(k) for k in bags}


def test_frequencies_are_exact_at_any_size(spark):
    """Frequent shingles have their exact weight, all others the same; the weights of a corpus repeated ten times are its own."""
    r = random.Random(37)
    rows = [" ".join(str(r.randrange(10**9)) for _ in range(30)) + (" every fifth text ends so" if i % 5 == 0 else "") + (" and one in a hundred so too" if i % 100 == 0 else "") for i in range(600)]
    one, ten = (spark.createDataFrame([(t,) for t in rows * k], "text string").repartition(7) for k in (1, 10))
    first, more = weighted_dedup.frequencies(one), weighted_dedup.frequencies(ten)
    bags = [shingle_bag(t) for t in rows]
    df = collections.Counter(s for b in bags for s in b)
    often = [s for s in df if df[s] > 3]
    assert len(first.keys) == len(often) and (first.keys == more.keys).all() and np.allclose(first.weights, more.weights) and first.rare == pytest.approx(more.rare)
    hashes = weighted_dedup.shingles(pa.array([" ".join(s) for s in often]))
    want = [1 + weighted_dedup.DAMPED * math.log(600 / df[s]) / math.log(200) for s in often]
    assert sorted(first(hashes[0])) == pytest.approx(sorted(want), rel=1e-5) and first(np.array([12345], np.uint64))[0] == pytest.approx(1.2)


def test_dedup_recall_of_true_pairs(spark):
    """Of all pairs of sf0.01 whose weighted similarity is at least 0.8, found by an inverted index of exact shingles, at least 0.99 share a class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in weighted_dedup.classes(docs).collect()}
    bags = {r.doc_id: shingle_bag(r.text or "") for r in docs.select("doc_id", "text").collect()}
    df = collections.Counter(s for b in bags.values() for s in b)
    n = sum(bool(b) for b in bags.values())
    weight = {s: 1 + weighted_dedup.DAMPED * math.log(n / max(c, n / 200)) / math.log(200) for s, c in df.items()}
    total = {k: sum(c * weight[s] for s, c in b.items()) for k, b in bags.items()}
    index = collections.defaultdict(list)
    for k, b in bags.items():
        for s in b:
            if df[s] > 1:
                index[s].append(k)
    shared = collections.Counter()
    for s, ks in index.items():
        for x, y in itertools.combinations(sorted(ks), 2):
            shared[x, y] += min(bags[x][s], bags[y][s]) * weight[s]
    true = [p for p, v in shared.items() if v >= 0.8 * (total[p[0]] + total[p[1]] - v)]
    assert len(true) >= 50 and sum(got[x] == got[y] for x, y in true) >= 0.99 * len(true)


def test_dedup_chain_is_not_lost(spark):
    """Each version replaces a part of the one before: neighbours are alike, the ends are not, and no leader matches all."""
    r = random.Random(9)
    words = [str(r.random()) for _ in range(400)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words)))
        words[i * 30 : i * 30 + 30] = [str(r.random()) for _ in range(30)]
    got = weighted_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.class_id for x in got.collect()} == {0}


def test_sampling_estimates_similarity():
    r = np.random.default_rng(10)
    a, b = np.sort(r.choice(10**6, 3000, replace=False)).astype(np.uint64), None
    for share in (0.3, 0.8):
        b = np.sort(np.concatenate([a[: int(3000 * 2 * share / (1 + share))], (r.choice(10**6, 3000) + 10**6).astype(np.uint64)[: 3000 - int(3000 * 2 * share / (1 + share))]]))
        hits = [np.mean(weighted_dedup.sample(common.mix(np.concatenate([a, b]) + np.uint64(k * 10**7)), np.full(6000, 2.5), np.array([0, 3000, 6000]))[0] == weighted_dedup.sample(common.mix(np.concatenate([b, a]) + np.uint64(k * 10**7)), np.full(6000, 2.5), np.array([0, 3000, 6000]))[0]) for k in range(40)]
        assert abs(np.mean(hits) - share) < 0.05


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), k, m.end()) for k, p, n in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)) for m in re.finditer(p, text) if len(m[0]) >= n]
    return sorted(found)


def test_secrets(spark):
    r = random.Random(11)
    parts = ["password", "PassWd", "toKen", "ſecret", "api_key", "apikey", "=", ": ", '"', "'", "AKIA", "ABCDEFGH1234567890", "0123456789abcdef", "deadbeef", " ", "é", "\n", "x1.y", "eyJ"]
    some = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(4000)]
    scanner = secret_scan.Scanner(secret_scan.BASE)
    assert scanner.spans(pa.array(some)) == [plain_spans(t) for t in some]
    queries = {r_.kind: q for r_, _, q in scanner.rules}
    assert queries["hex"] == secret_scan.ALL and queries["access"] == ("and", ("tri", b"aki"), ("tri", b"kia")) and queries["assign"][0] == "or"
    clean = secret_scan.redact(spark.createDataFrame([(1, "x password=abcdefgh y", 21), (2, None, 0)], "doc_id long, text string, n_chars int")).collect()
    assert [(x.text, x.n_chars) for x in clean] == [("x [assign] y", 12), (None, 0)]


def test_quality(docs, texts):
    got = quality_rules.rules(docs).toPandas().set_index("doc_id")
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        threes = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {i + j for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for j in range(3)}
        r = got.loc[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(marked))
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_host_rates_equal_the_plain_formula(spark):
    """Every rule's rate at every host, shrunk by hand; hosts of one document and of a third of all; no source, no host."""
    r = random.Random(31)
    good = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    kinds = [good, lambda: "too short", lambda: "a b c " * 30, lambda: good() + " ###########", lambda: (good() + "\n") + "same line\n" * 9]
    hosts = ["big"] * 60 + [f"h{i}" for i in range(12) for _ in range(1 + i % 4 * 5)] + [None] * 6 + [""] * 4
    rows = [(i, kinds[(zlib.crc32(str(h).encode()) + (r.random() < 0.5) * r.randrange(5)) % 5](), h) for i, h in enumerate(hosts)]
    got = quality_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().set_index("doc_id")
    fails = {}
    for i, t, h in rows:
        w, lines = t.split(), [x for x in t.split("\n") if x.strip()]
        threes = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {k + j for k in range(len(w) - 2) if threes[tuple(w[k : k + 3])] > 1 for j in range(3)}
        fails[i] = [len(w) < 50, 100 * len(marked) > 50 * len(w), 10 * sum(t.count(c) for c in "#*$%&|<>") > len(w), 10 * (len(lines) - len({*lines})) > 3 * len(lines)]
    named = {h for h in hosts if h is not None}
    of = {h: [fails[i] for i, _, x in rows if x == h] for h in named}
    n = sum(map(len, of.values()))
    rate = {h: [] for h in named}
    for k in range(4):
        bad = {h: sum(f[k] for f in of[h]) for h in named}
        mean = sum(bad.values()) / n
        spread = (sum(len(of[h]) * (bad[h] / len(of[h]) - mean) ** 2 for h in named) - (len(named) - 1) * mean * (1 - mean)) / (n - sum(len(x) ** 2 for x in of.values()) / n)
        strength = min(10_000, max(1, mean * (1 - mean) / spread - 1)) if spread > 0 else 10_000
        for h in named:
            rate[h].append((bad[h] + mean * strength) / (len(of[h]) + strength))
    names = ["few_words", "repeated_words", "symbols", "equal_lines"]
    for i, _, h in rows:
        want = ",".join(x for x, y in zip(names, rate.get(h, [0] * 4), strict=True) if y > 0.5)
        assert got.host_rules[i] == want and got.kept[i] == (not want and not any(fails[i][:2]))
        assert math.isnan(got.host_rate[i]) if h is None else got.host_rate[i] == pytest.approx(max(rate[h]))
    assert len({*got.host_rules}) > 1 and got.kept.any()


def test_joins_of_any_skew(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 500}", i) for i in range(1000)] + [(None, 1), ("lacking", 2)]
    table = [("hot", 3000, "a")] + [(f"k{i}", 2, "b") for i in range(500)]
    got = common.with_heavy(spark.createDataFrame(rows, "k string, v int"), spark.createDataFrame(table, "k string, n long, x string"), ["k"], "n")
    assert collections.Counter(r.x for r in got.collect()) == {"a": 3000, "b": 1000, None: 2}


def test_bad_hosts_go(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good, "a") for i in range(50)] + [(100 + i, bad if i else good, "b") for i in range(30)] + [(200, bad, "c")]
    got = {r.doc_id: r.kept for r in quality_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(50)) and not got[100] and not got[200]


def test_chats(spark):
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    r = random.Random(12)
    bits = ["<|", "\\", "-", "a", "<", "|", "[INST]", "end|>", "<|end|>\n", "</s>", "\n"]
    rows = [(c, t, r.choice(["user", "assistant", None]), None if r.random() < 0.05 else "".join(r.choice(bits) for _ in range(r.randrange(6)))) for c in range(40) for t in range(r.choice([1, 3, 90]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {x.conv_id: x for x in chat_format.digests(chat_format.format_chats(df)).collect()}
    for c, own in pd.DataFrame(rows, columns=["c", "t", "role", "text"]).groupby("c"):
        own = own.fillna("").sort_values("t")
        said = "".join(f"{a}\n{b}\n" for a, b in zip(own["role"], own["text"], strict=True))
        learned = "".join(b for a, b in zip(own["role"], own["text"], strict=True) if a == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].n_rewritten) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), 0)
    forget = lambda turns: "".join(t for _, t in turns[-2:])
    assert chat_format.locate([("a", "1"), ("b", "2"), ("a", "3")], forget).rewritten == [2]
    assert all(not any(k in chat_format.escape(x[3] or "") for k in chat_format.CONTROL) for x in rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert after.columns == docs.columns and 0 < after.count() <= docs.count()
            docs = after
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == kept
    direct = corpus_pipeline.run(spark, SF)
    assert direct.count() == after.count()
    assert not any(plain_spans(r.text) for r in docs.collect())


def test_scratch_tables_go(spark):
    with common.scratch() as tables:
        gone, kept = common.staged(spark.range(3).toDF("x"), "a"), common.staged(spark.range(2).toDF("x"), "b")
        tables.remove(kept)
    there = lambda df: spark._jvm.org.apache.hadoop.fs.Path(df._staged_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(df._staged_path))
    assert not there(gone) and there(kept) and kept.count() == 2


def test_staging_reads_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = common.staged(spark.range(3).toDF("x"), "t")
    assert df.count() == 3 and df._staged_path.startswith(common.shared_dir(spark))
