"""Language ID, SentencePiece, license scan, quality rules, toxicity, packing and URLs."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import documents, edge_rows, prose
from vekta.llm import common, language_id, license_scan, packing, quality_rules, sentencepiece_codec, toxicity, url_filter, workloads

PIECE, BYTE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = st.text(alphabet="ab the\n\t\r _=-▁日本𝔘é\x00\x1c\x85\xa0²½Ⅷ's'll12ﬁ̈", max_size=60)


def held(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_slices_and_ngrams_stay_inside_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["abcd", None, "ab", "bcd" * 10])], ["text"])
    parts = list(common.text_slices(iter([b]), "text", 8))
    assert sum(p.num_rows for p in parts) == 4 and len(parts) > 1
    row, bucket = common.byte_ngrams(*common.utf8(b.column("text").slice(0, 3)), 3, 64)
    assert row.tolist() == [0, 0]
    tail = common.byte_ngrams(*common.utf8(b.column("text").slice(3)), 3, 64)[1]
    assert bucket[1] == tail[0]
    assert common.numbered(["a\x00b", "a\x00c", "a\x00b"])[0].tolist() == [0, 1, 0]


# ---- SentencePiece

@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_encoding_equals_the_library(texts):
    v, sp = sentencepiece_codec.vocabulary(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ids, n = v.encode(texts)
    cut = np.concatenate([[0], np.cumsum(n)])
    for k, t in enumerate(texts):
        assert ids[cut[k]:cut[k + 1]].tolist() == sp.encode(t)
    assert [x.decode() for x in v.decode(ids, n)] == [sp.decode(sp.encode(t)) for t in texts]


def test_long_words_are_merged_in_order():
    v, sp = sentencepiece_codec.vocabulary(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for t in (" " * 999, "ab" * 3000, "-" * 700 + "the" * 500, "aaaaaaaaa bbbb" * 50):
        assert v.encode([t])[0].tolist() == sp.encode(t)


def test_round_trip_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = edge_rows()
    got = held(sentencepiece_codec.round_trip(documents(spark, rows), PIECE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in rows:
        ids = sp.encode(t or "") + [2]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    coded = sentencepiece_codec.encode_documents(documents(spark, rows[:4]), PIECE)
    assert held(sentencepiece_codec.decode_documents(coded, PIECE), "doc_id", "text") == [(1, ""), (2, ""), (3, " \n\t "), (4, "a")]
    assert sentencepiece_codec.round_trip(documents(spark, []), PIECE).count() == 0


# ---- language ID

def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.op4_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held_out = out[out.held_out]
    assert (held_out.lang_pred == held_out.lang).mean() > 0.98
    assert out.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]
    assert ((out.score >= 0) & (out.score <= 1)).all() and out.rejected.mean() < 0.02


def test_language_edges(spark, sf):
    model = language_id.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    docs = documents(spark, edge_rows()).withColumn("letters", F.lit("clash"))
    got = defaultdict(set)
    for r in language_id.identify(docs, model).collect():
        got[r.doc_id].add((r.lang_pred, r.rejected))
    for i in (1, 2, 3, 8):
        assert got[i] == {("und", True)}
    assert got[9] == {("en", False)}
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 9").count() == 2 and kept.where("doc_id IN (1, 2, 3, 8)").count() == 0
    none = language_id.learn(documents(spark, []))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(documents(spark, []), model).count() == 0
    assert language_id.keep_identified(documents(spark, []), model).count() == 0


def rejected_share(spark, model, texts):
    got = language_id.identify(documents(spark, list(enumerate(texts))), model).collect()
    return sum(r.rejected for r in got) / len(got)


def test_unknown_languages_and_junk_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 40")
    g = random.Random(3)
    noise = [bytes(g.randrange(256) for _ in range(1500)) for _ in range(20)]
    model = language_id.learn(docs)
    assert rejected_share(spark, model, [base64.b64encode(n).decode() for n in noise]) == 1
    natural = ["De snelle bruine vos springt over de luie hond en de kat zit in het huis terwijl het regent buiten.",
               "A raposa marrom rápida pula sobre o cachorro preguiçoso e o gato fica em casa enquanto chove.",
               "Szybki brązowy lis skacze nad leniwym psem, a kot siedzi w domu, kiedy pada deszcz.",
               "Быстрая коричневая лиса прыгает через ленивую собаку, а кошка сидит дома."]
    assert rejected_share(spark, model, natural) == 1
    for lang in ("de", "en", "es", "fr"):
        others = language_id.learn(docs.where(F.col("lang") != lang))
        left_out = [r.text for r in docs.where(F.col("lang") == lang).limit(150).collect()]
        assert rejected_share(spark, others, left_out) > 0.8, lang
        assert rejected_share(spark, model, left_out) < 0.02, lang


def test_predictions_equal_plain_loops(spark, sf):
    model = language_id.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = [prose(11, 3), prose(12, 300), "Ü", "das ist ein Satz", "", "123", None, "le chat est là " * 50]
    lang, score, rejected = (a.to_pylist() for a in language_id.predictions(
        model, pa.array(texts, pa.string()), pa.array([bool(t) and any(c.isalpha() for c in t) for t in texts])))
    for t, name, s, r in zip(texts, lang, score, rejected):
        if not t or not any(c.isalpha() for c in t):
            assert (name, s, r) == ("und", 0.0, True)
            continue
        v = language_id.unit_vectors(language_id.term_counts(pa.array([t])), model.idf)[0].astype(float)
        ends = [*model.starts[1:], len(model.centroids)]
        sims = [max(float(v @ model.centroids[j]) for j in range(a, e)) for a, e in zip(model.starts, ends)]
        best = max(range(len(sims)), key=lambda i: (sims[i], -i))
        band = int((v != 0).sum()).bit_length()
        lead = 1 - max(x for i, x in enumerate(sims) if i != best) / sims[best]
        assert name == model.langs[best] and abs(s - sims[best]) < 1e-5
        assert r == (sims[best] < model.near[best, band] or lead < model.lead[best, band])


# ---- license scan

def licensed():
    mit, apache = license_scan.TEMPLATES["mit"], license_scan.TEMPLATES["apache-2.0"]
    return [(20, "CC-BY! cc by CC\nBY cc by cc by."), (21, prose(4, 90) + "\n" + apache.upper().replace(" ", "\n") + ".\n" + prose(5, 70)),
            (22, "All rights, reserved; general PUBLIC licenses. general public license"), (23, " ".join(mit.split()[:9])),
            (24, " ".join(reversed(mit.split())) + " " + prose(6, 400)), (25, "É cc by")]


def by_sql(rows, **how):
    con = duckdb.connect()
    docs = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})  # noqa: F841
    con.register("documents", docs)
    return sorted(con.execute(license_scan.license_sql(**how)).fetchall(), key=str)


def test_license_scan_equals_sql(spark):
    rows = licensed() + edge_rows()
    got = license_scan.scan_licenses(documents(spark, rows).selectExpr("*", "1 AS spaced", "2 AS text_key", "3 AS WORDS", "4 AS found"))
    assert sorted(map(tuple, got.collect()), key=str) == by_sql(rows)
    by_id = {r.doc_id: r for r in got.collect()}
    assert (by_id[20].n_base, by_id[20].first_word, by_id[20].last_word, by_id[20].base_labels) == (5, 0, 8, "cc-by")
    assert by_id[21].labels == "apache-2.0" and by_id[24].labels == "mit" and by_id[23].labels == ""
    assert by_id[22].base_labels == "gpl,reserved"
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0
    assert "ArrowPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_licenses_that_differ_in_the_deciding_word(spark):
    gpl = "This work is licensed under the GNU {}General Public License{}."
    want = {
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0", "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
        "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC-SA 4.0": "cc-by", "Licensed under CC BY-NC-ND 4.0": "cc-by", "Licensed under CC BY-SA 3.0": "cc-by",
        "Licensed under CC BY-NC 4.0, not licensed under CC BY-SA 4.0": "cc-by,cc-by-nc-4.0,cc-by-sa-4.0",
        gpl.format("", ", version 3"): "gpl,gpl-3.0", gpl.format("", ", version 2"): "gpl", gpl.format("Lesser ", " version 2.1"): "gpl",
        gpl.format("Lesser ", " version 3"): "gpl", gpl.format("Affero ", " version 3"): "gpl", gpl.format("", " (GPL) v3"): "gpl,gpl-3.0",
        gpl.format("", " as published by the Free Software Foundation, either version 3 of the License"): "gpl,gpl-3.0",
        gpl.format("", " version 2 or version 3"): "gpl,gpl-3.0", gpl.format("", ", version 2. See section 3"): "gpl",
        "This work is licensed under version 3 of the GNU General Public License": "gpl,gpl-3.0",
        "This work is licensed under version 2 of the GNU General Public License, section 3": "gpl",
        "Licensed under the Apache License, Version 2.0": "apache-2.0", "Licensed under the Apache License, Version 1.1; 2 files": "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software covered by this license": "",
    }
    texts = list(want) + [prose(7, 50) + " " + t + " " + prose(8, 90) for t in want]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(documents(spark, list(enumerate(texts)))).collect()}
    assert {(k % len(want), v) for k, v in got.items()} == set(enumerate(want.values()))


def test_confirmation_equals_sql_with_any_templates(spark):
    g = random.Random(4)
    parts = ("licensed under this work is the gnu general public license version 2 3 or v3 lesser affero library of cc by nc sa nd 4 0 apache mozilla "
             "terms subject source code form 12 v2 and versions 1 later").split()
    rows = [(k, " ".join(g.choice(parts) for _ in range(g.randint(4, 70)))) for k in range(1500)]
    for base in license_scan.TEMPLATES.values():
        for k in range(60):
            words = base.split()
            for _ in range(g.randint(0, 4)):
                words.insert(g.randint(0, len(words)), g.choice(parts))
            rows.append((2000 + len(rows), " ".join(words)))
    more = license_scan.TEMPLATES | {"own": "a notice of our own house", "long": " ".join(f"w{k}" for k in range(70))}
    rows.append((9000, "x " * 40 + more["long"] + " a notice of our own house " + "licensed under cc by nc 4 0"))
    for templates in (license_scan.TEMPLATES, more):
        got = license_scan.scan_licenses(documents(spark, rows), templates=templates)
        assert sorted(map(tuple, got.collect()), key=str) == by_sql(rows, templates=templates)


def test_a_long_template_is_found_at_every_offset(spark):
    long = [f"t{k}" for k in range(150)]
    middle = [f"m{k}" for k in range(50)]
    templates = {"long": "The " + ", ".join(long[1:]).upper(), "middle": " ".join(middle), "short": "s1 s2 s3"}
    rows = [(k, " ".join([*["x"] * k, "the", *long[1:], *["y"] * 700])) for k in range(0, 520)]
    rows += [(1000 + k, " ".join([*["x"] * k, *middle, *["y"] * 200])) for k in range(130)] + [(2000, "s1 " + "x " * 70 + "s2 s3"), (2001, "a s3 s2 s1")]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(documents(spark, rows), templates=templates).collect()}
    assert {got[k] for k in range(520)} == {("long", 1.0)} and {got[1000 + k] for k in range(130)} == {("middle", 1.0)}
    assert got[2000] == ("", 0.0) and got[2001] == ("short", 1.0)
    assert [license_scan.widening(n) for n in (0, 17, 33, 34, 65, 66, 150)] == [1, 1, 1, 2, 2, 4, 8]


# ---- quality rules

def brute_quality(t):
    w = (t or "").encode().split()
    lines = [x for x in (t or "").encode().split(b"\n") if x.strip()]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def test_base_counts_equal_brute_force(spark):
    rows = edge_rows() + [(30, "a b c a b c a\n\n x \n x \nx\n #*$%&|<> a b c"), (31, "a\x0bb\x0cc\rd\xa0e\x1cf\x85g"), (32, "To " * 80)]
    out = quality_rules.judge(documents(spark, rows), np.zeros(quality_rules.BUCKETS))
    got = held(out, "doc_id", *quality_rules.COUNTS, "base_failed", "kept")
    want = []
    for i, t in rows:
        c = brute_quality(t)
        bad = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((i, *c, bad, not bad))
    assert got == sorted(want, key=str)


def test_ratios_equal_brute_force_and_keep_good_texts(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trusted = quality_rules.trusted_ids(labels)
    ratios = quality_rules.fit_ratios(docs, trusted)
    raw, good = np.ones(quality_rules.BUCKETS), np.ones(quality_rules.BUCKETS)
    for r in docs.collect():
        b = common.byte_ngrams(*common.utf8(pa.array([r.text])), quality_rules.NGRAM, quality_rules.BUCKETS)[1]
        np.add.at(raw, b, 1)
        if r.doc_id in trusted:
            np.add.at(good, b, 1)
    assert np.allclose(ratios, np.log(good / good.sum()) - np.log(raw / raw.sum()))
    out = quality_rules.judge(docs, ratios).join(labels, "doc_id").toPandas()
    passed = out[~out.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.99 and passed[passed.quality == 0].kept.mean() < 0.05
    kept = quality_rules.keep_good(docs.withColumn("kept", F.lit("clash")), ratios)
    assert kept.columns == [*docs.columns, "kept"] and kept.count() == quality_rules.judge(docs, ratios).where("kept").count()


def test_quality_without_labels_or_rows(spark):
    docs = documents(spark, edge_rows())
    assert not quality_rules.fit_ratios(docs, np.zeros(0, np.int64)).any()
    assert not quality_rules.fit_ratios(documents(spark, []), np.zeros(0, np.int64)).any()
    assert quality_rules.judge(documents(spark, []), np.zeros(quality_rules.BUCKETS)).count() == 0


# ---- toxicity

def test_gradient_by_finite_differences():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    table, code, counts = toxicity.coded(["the quick fox", "a b c d e f g h i j k " * 8, ""])
    text, start, length = toxicity.windows(counts)
    y = (np.arange(len(text)) % 2).astype(float)

    def loss():
        z = net.logits(table, code, start, length).astype(float)
        return np.mean(np.logaddexp(0, -z) * y + np.logaddexp(0, z) * (1 - y))

    grad = net.gradient(table, code, start, length, y)
    for name, p in net.p.items():
        flat, i = p.reshape(-1), int(np.argmax(np.abs(grad[name])))
        old = flat[i]
        flat[i] = old + 1e-3
        up = loss()
        flat[i] = old - 1e-3
        down = loss()
        flat[i] = old
        assert abs((up - down) / 2e-3 - grad[name].reshape(-1)[i]) < 1e-4, name


def test_windows_cover_every_word():
    counts = np.array([0, 1, 32, 33, 56, 57, 500])
    text, start, length = toxicity.windows(counts)
    first = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        own = text == k
        covered = {w for s, m in zip(start[own], length[own]) for w in range(s, s + m)}
        assert covered == set(range(first[k], first[k] + n))


def test_network_finds_an_insult_in_one_window(spark):
    bad = ["idiot", "moron", "scum"]
    texts = [prose(k, 60) + (f" {bad[k % 3]} " if k % 2 else " ") + prose(1000 + k, 60) for k in range(640)]
    net = toxicity.train(texts[:600], np.arange(600) % 2)
    docs = documents(spark, list(enumerate(texts[600:])))
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, net).collect()}
    assert np.mean([(got[k] >= 0.5) == (k % 2 == 1) for k in got]) > 0.95
    edges = toxicity.score_texts(documents(spark, edge_rows()), net)
    assert edges.count() == len(edge_rows()) and edges.where("score IS NULL OR isnan(score) OR score < 0 OR score > 1").count() == 0
    assert toxicity.score_texts(documents(spark, []), net).count() == 0
    assert isinstance(toxicity.train([], np.zeros(0, np.int64)), toxicity.Network)


# ---- packing

@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_byte_ids_equal_the_library(texts):
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    ids, n = packing.tokenizer(BYTE).encode(texts)
    cut = np.concatenate([[0], np.cumsum(n)])
    for k, x in enumerate(texts):
        assert ids[cut[k]:cut[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(ODD, st.sampled_from(["<|endoftext|>", "<|endoftext|", "<", " "])), max_size=6).map("".join), max_size=6))
def test_added_tokens_equal_the_library_as_loaded(texts):
    t = Tokenizer.from_file(BYTE)
    texts = [*texts, "a<|endoftext|>b", "<|endoftext|><|endoftext|> x  <|endoftext|>", "<|<|endoftext|>|>"]
    ids, n = packing.tokenizer(BYTE).encode(texts)
    cut = np.concatenate([[0], np.cumsum(n)])
    for k, x in enumerate(texts):
        assert ids[cut[k]:cut[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


def test_packing_counts_an_added_token_once(spark):
    out = packing.pack_documents(documents(spark, [(1, "a<|endoftext|>b")]), BYTE).collect()
    assert [(r.length, r.ids) for r in out] == [(4, [64, 50256, 65, 2])]


def check_packing(rows, out, capacity=1024):
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    want = Counter()
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity
        cuts = sorted({0, *range(first, len(ids) + 1, capacity)})
        for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[(i, p, s, e - s, zlib.crc32(ids[s:e].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@pytest.mark.parametrize("first,most", [(10_000, 200_000), (20, 60)])
def test_packing_is_whole_and_tight(spark, monkeypatch, first, most):
    monkeypatch.setattr(packing, "FIRST_ITEMS", first)
    monkeypatch.setattr(packing, "ITEMS_A_TASK", most)
    monkeypatch.setattr(packing.assign_bins, "__defaults__", (packing.CAPACITY, most))
    rows = [(k, prose(k, 20 + (k * 37) % 700)) for k in range(300)] + edge_rows()
    out = packing.pack_documents(documents(spark, rows), BYTE, keep_ids=False).collect()
    bins = check_packing(rows, out)
    assert len(bins) <= 1.05 * sum(r.length for r in out) / 1024 + 1


def test_items_that_never_fit_together_end(spark):
    pieces = spark.range(500).select(F.col("id").alias("uid"), F.lit(600).cast("long").alias("length"))
    out = packing.assign_bins(pieces, 1024, 50).collect()
    assert len({r.sequence_id for r in out}) == len(out) == 500


def test_packing_keeps_ids_and_takes_empty_tables(spark):
    out = packing.pack_documents(documents(spark, [(1, "hello world")]), BYTE).collect()
    assert Tokenizer.from_file(BYTE).decode(out[0].ids[:-1]) == "hello world" and out[0].ids[-1] == 2
    assert packing.pack_documents(documents(spark, []), BYTE, keep_ids=False).count() == 0


def test_best_fit_takes_the_fullest_bin():
    bins, at, free = packing.best_fit(np.array([700, 600, 300, 400, 24]), 1024)
    assert bins.tolist() == [0, 1, 0, 1, 0] and at.tolist() == [0, 0, 700, 600, 1000] and free == [0, 24]


# ---- URLs

def brute_url(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=lambda x: len(x[0])) if fit else None


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/1?x=/#y", "https://www.example.com/en/", "http://example.com", "http://com/", "http://net/es/x",
            "http://ÀB.net/fr/", "x://http://a.net/es/", "http://a.net?b=/es/", "http://xnet/es/", "http://b.net/ES/", "://", "http://" + "q" * 20_000 + "/a", "http://a\nb.com/\nc"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("grams", F.lit(1))
    model = url_filter.train_url_model(url_filter.labelled_urls(spark), rounds=3)
    out = url_filter.filter_urls(pages, model)
    got = {r.page_id: r for r in out.collect()}
    for k, u in enumerate(urls):
        host, path, fit = brute_url(u, url_filter.RULES)
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, fit[0] if fit else None)
        assert r.verdict == (fit[1] if fit else "block" if r.score >= 0.5 else "allow") and 0 <= r.score <= 1
    assert url_filter.filter_urls(pages.limit(0), model).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_url_model_separates_its_table(spark):
    labelled = url_filter.labelled_urls(spark)
    model = url_filter.train_url_model(labelled)
    right = url_filter.filter_urls(labelled, model, rules=[]).where((F.col("score") >= 0.5) == (F.col("label") == 1)).count()
    assert right >= 0.95 * len(url_filter.LABELLED)
    assert url_filter.train_url_model(labelled.limit(0), rounds=2)[1] == 0.0


def test_queries_are_registered():
    assert {q.split("_")[0] for q in workloads.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(workloads.ORACLE) <= set(workloads.QUERIES)
