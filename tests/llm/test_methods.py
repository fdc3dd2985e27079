import random

import numpy as np
import pytest
import sentencepiece
from brute import Languages, article, components, counts, fertility, fingerprint, mixed, quality_score, toxicity_score, without_repeats
from corpus import ODD, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from simvane.llm import bpe, components as cc, embedding_dedup, html_text, labelled, language_id, line_dedup, mixing, nbsvm, quality_rules, simhash, toxicity
from simvane.llm import text as tx
from simvane.llm.vocabularies import path

VOCABULARY = path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)


def by_library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


CODEC = bpe.Codec(bpe.Tables(VOCABULARY))


def by_automaton(*texts):
    ids, counts = CODEC.encode(list(texts))
    assert CODEC.decode(ids, counts).to_pylist() == [LIBRARY.decode(by_library(t), skip_special_tokens=False) for t in texts]
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


ANY_TEXT = st.one_of(st.text(max_size=40), st.text("ab", max_size=24), st.text("thein gao'ds!?.velmr", max_size=40), st.text("aé'sñ²1 ß\u0301", max_size=20), st.sampled_from(["a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "aaa" * 60, "ﬁ Σ İ \ufdd0\ue000", "<|endoftext|>" * 3 + "ΣΑΣ"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(ANY_TEXT, min_size=1, max_size=4))
def test_automaton_encodes_as_the_library(texts):
    assert by_automaton(*texts) == [by_library(t) for t in texts]


def test_words_beyond_the_memory(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 40)
    texts = [prose(i, 60) + " " + "thein" * 30 for i in range(12)]
    assert [by_automaton(t)[0] for t in texts] == [by_library(t) for t in texts]
    assert len(CODEC.known) <= 40


def test_long_texts_are_cut_at_spaces(monkeypatch):
    long = [(prose(2, 300) + " ") * 1500, "xyz" * 20_000, ("the<|endoftext|> é" + prose(1, 100)) * 900]
    assert len(long[0]) > 2 * bpe.BLOCK and by_automaton(*long) == [by_library(t) for t in long]
    monkeypatch.setattr(bpe, "BLOCK", 50)
    text = prose(1, 400) + " <|endoftext|>" + "x" * 300
    assert by_automaton(text, "", text) == [by_library(text), [], by_library(text)] and "".join(bpe.pieces(text)) == text


def test_transitions_match_merging_by_hand():
    """Arc b leaves state a exactly where merging the letters of a and b gives a, b again."""
    merges = [(0, 1, 2), (2, 0, 3), (0, 0, 4), (1, 4, 5), (4, 0, 6), (2, 2, 7)]
    automaton = bpe.Automaton(8, [0, 1], merges)
    spelled = {0: [0], 1: [1]}
    for u, v, w in merges:
        spelled[w] = spelled[u] + spelled[v]

    def merged(letters):
        for u, v, w in merges:
            out = []
            for x in letters:
                if out and out[-1] == u and x == v:
                    out[-1] = w
                else:
                    out.append(x)
            letters = out
        return letters

    own = [w for w in spelled if merged(spelled[w]) == [w]]
    pairs = [(a, b) for a in own for b in own]
    assert automaton.arcs(*(np.array(x) for x in zip(*pairs))).tolist() == [merged(spelled[a] + spelled[b]) == [a, b] for a, b in pairs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t#é"), max_size=60), max_size=6))
def test_counts_match_plain_ones(texts):
    import pyarrow as pa

    found = tx.per_block(pa.array(texts, pa.string()), lambda d, o: quality_rules.base_counts(d, o)[0], 32)
    assert [tuple(int(found[c][i]) for c in quality_rules.COUNTS) for i in range(len(texts))] == [counts(t) for t in texts]


RULES = quality_rules.Rules(path("piece_bpe_32k.model"), path("byte_bpe_multi_50k.tiktoken"))


def judged(texts):
    import pyarrow as pa

    cutter = quality_rules.Fertility(RULES)
    return tx.per_block(pa.array(texts, pa.string()), lambda d, o: quality_rules.judge(d, o, RULES, cutter))


def test_fertility_matches_plain_one(monkeypatch):
    texts = [prose(i, 60) for i in range(4)] + ["日本語 ▲ xx", ""]
    plain = sentencepiece.SentencePieceProcessor(model_file=RULES.vocabulary), quality_rules.byte_pairs(RULES.pairs)
    for most in (200_000, 30):
        monkeypatch.setattr(quality_rules.Fertility, "MOST", most)
        found = judged(texts)
        for i, t in enumerate(texts):
            assert [found[k][i] for k in ("tokens", *quality_rules.MEASURES)] == pytest.approx(list(fertility(t, *plain)))


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_counts_tell_alike_hashes_apart():
    """A polynomial modulo 2^64 can't tell the Thue-Morse word from its complement."""
    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [f"{word}\n{other}\n{word}", f"{word} x y {other} x y {word} x z"] + [f"{word}\n{other}"] * 2
    found = judged(texts)
    assert [tuple(int(found[c][i]) for c in quality_rules.COUNTS) for i in range(len(texts))] == [counts(t) for t in texts]


def test_windows_of_many_distinct_words(monkeypatch):
    words = np.array([0, 1, 5 << 21, 0, 1, 5 << 21, 1, 0], np.int64)
    assert quality_rules.repeated_windows(np.zeros(8, np.int64), words).tolist() == [True] * 6 + [False] * 2
    assert not quality_rules.repeated_windows(np.array([0, 0, 0, 1, 1, 1, 1, 1]), words).any()


#: Prose of several languages, each well over fifty words when told twice in other orders, and what spoils it.
PROSE = {
    "latin": "The ship left the harbour before sunrise and nobody on the quay could say which captain had given the order. A grey wind came down from the hills, carrying the smell of wet hay and of coal smoke, while two fishermen argued about the price of rope. Later that morning the postmaster found an unsigned letter on his desk, folded twice, written in a careful hand that he almost recognised from years before.",
    "polish": "Statek opuścił port przed wschodem słońca i nikt na nabrzeżu nie potrafił powiedzieć, który kapitan wydał rozkaz. Szary wiatr schodził ze wzgórz, niosąc zapach mokrego siana i dymu, podczas gdy dwaj rybacy spierali się o cenę liny. Później tego ranka naczelnik poczty znalazł na biurku niepodpisany list, złożony na dwoje, napisany starannym pismem, które prawie rozpoznał sprzed wielu lat, choć nie umiał przypomnieć sobie nazwiska.",
    "vietnamese": "Con tàu rời bến cảng trước khi mặt trời mọc và không ai trên bến có thể nói thuyền trưởng nào đã ra lệnh. Một cơn gió xám thổi xuống từ những ngọn đồi, mang theo mùi cỏ ướt và khói than, trong khi hai người đánh cá tranh cãi về giá dây thừng. Sáng hôm đó muộn hơn, người đưa thư tìm thấy trên bàn một lá thư không ký tên, gấp làm đôi, viết bằng nét chữ cẩn thận mà ông gần như nhận ra.",
    "cyrillic": "Корабль вышел из гавани ещё до рассвета, и никто на набережной не мог сказать, какой капитан отдал приказ. С холмов дул серый ветер, он нёс запах мокрого сена и угольного дыма, а двое рыбаков спорили о цене верёвки. Позже тем же утром почтмейстер нашёл на своём столе письмо без подписи, сложенное вдвое и написанное аккуратным почерком, который он почти узнал, хотя прошло уже много лет с тех пор.",
    "greek": "Το πλοίο έφυγε από το λιμάνι πριν από την ανατολή και κανείς στην προκυμαία δεν μπορούσε να πει ποιος καπετάνιος είχε δώσει τη διαταγή. Ένας γκρίζος άνεμος κατέβαινε από τους λόφους, φέρνοντας τη μυρωδιά του βρεγμένου άχυρου και του καπνού, ενώ δύο ψαράδες μάλωναν για την τιμή του σχοινιού. Αργότερα εκείνο το πρωί ο ταχυδρόμος βρήκε πάνω στο γραφείο του ένα ανυπόγραφο γράμμα, διπλωμένο στα δύο.",
}


def test_natural_prose_is_kept():
    texts = [*PROSE.values(), "".join(f"今天早上第{i}艘船离开港口，码头上的人不知道是谁下的命令 " for i in range(60)).replace("第", " 第 ")]
    found = judged(texts)
    assert found["script"].tolist() == ["latin", "latin", "latin", "cyrillic", "greek", "han"]
    assert not found["base_failed"][:5].any() and found["kept"][:5].all()


def test_each_measure_rejects_something():
    """Each measure alone puts some text outside its band."""
    r = random.Random(4)
    words = PROSE["latin"].split()
    texts = {
        "chars_per_token": [" ".join("".join(r.choices("qxzjkvw7#*%&^", k=7)) for _ in range(90))],
        "chars_per_pair": [" ".join("".join(r.choices("abcdef0123456789", k=8)) for _ in range(90))],
        "fallback_share": [" ".join(w + (chr(0x16A0 + r.randrange(70)) if i % 3 == 0 else "") for i, w in enumerate(words))],
        "token_entropy": [" ".join(r.choice(["yes", "no", "or", "not", "so"]) for _ in range(400))],
    }
    found = judged([t for ts in texts.values() for t in ts])
    band = RULES.bands["latin"]
    reach = np.minimum(np.log2(found["tokens"]), 10)
    outside = {
        "chars_per_token": (found["chars_per_token"] < band.chars_per_token[0]) | (found["chars_per_token"] > band.chars_per_token[1]),
        "chars_per_pair": (found["chars_per_pair"] < band.chars_per_pair[0]) | (found["chars_per_pair"] > band.chars_per_pair[1]),
        "fallback_share": found["fallback_share"] > band.fallback_share,
        "token_entropy": found["token_entropy"] < band.entropy_ratio * reach,
    }
    assert (found["script"] == "latin").all() and not found["kept"].any()
    assert all(outside[m][i] for i, m in enumerate(texts))


def test_lines_match_plain_version(spark):
    r = random.Random(3)
    docs = {i: "\n".join(r.choice(["a", "b", "c", "", " ", "d d"]) for _ in range(r.randint(0, 14))) for i in range(60)}
    got = {x["doc_id"]: (x["text"], x["n_lines"]) for x in line_dedup.line_dedup(documents(spark, docs.items())).collect()}
    assert got == {i: (t, docs[i].count("\n") + 1) for i, t in without_repeats(docs).items()}


def test_anchors_cover():
    r = np.random.default_rng(0)
    values = r.integers(0, 1 << 31, 500).astype(np.uint32)
    home, reach = simhash.anchors(values)
    assert (simhash.syndromes(home) == 0).all() and (np.bitwise_count(home ^ values) <= 1).all()
    assert (simhash.syndromes(reach.ravel()) == 0).all() and (np.bitwise_count(reach ^ values[:, None]) <= 2).all()
    for _ in range(300):
        a = int(r.integers(0, 1 << 63))
        b = a
        for bit in r.choice(64, r.integers(0, 4), replace=False):
            b ^= 1 << int(bit)
        sides = [simhash.replicate(np.array([x], np.uint64).view(np.int64)) for x in (a, b)]
        assert {*sides[0][0][sides[0][2]].tolist()} & {*sides[1][0].tolist()}


@pytest.mark.parametrize("chunk", [4096, 3])
def test_fingerprints_and_groups_match_plain_ones(spark, chunk):
    r = random.Random(5)
    rows = [(i, prose(i % 9, 120)) for i in range(27)] + [(100 + i, None if i == 0 else "") for i in range(3)]
    rows += [(200 + i, prose(1, 120).replace(r.choice(["the", "of"]), "uh", 1)) for i in range(12)] + [(i + 300, t) for i, t in ODD if i]
    got = [(x["doc_id"], int(x["fingerprint"], 16), x["component_id"]) for x in simhash.simhash_groups(documents(spark, rows), simhash.Parameters(chunk=chunk)).collect()]
    prints = [(i, fingerprint(t)) for i, t in rows]
    assert sorted(x[:2] for x in got) == sorted(prints)
    least = {}
    for i, f in prints:
        least[f] = min(i, least.get(f, i))
    root = components(sorted(least), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for f, r in root.items():
        first[r] = min(least[f], first.get(r, least[f]))
    assert all(c == first[root[f]] for _, f, c in got)


@pytest.mark.parametrize("chunk", [1, 2, 4096])
def test_lone_pairs_of_two_chunks_link(spark, chunk):
    distinct = spark.createDataFrame([(0,), (3,), (4,), (1 << 40,), (-1,)], "fp long")
    root = {r["node"]: r["root"] for r in cc.connected_components(simhash.close_edges(distinct, simhash.Parameters(chunk=chunk))).collect()}
    assert root == {0: 0, 3: 0, 4: 0, 1 << 40: 0}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 120)] + [(500, 499), (499, 498), (7, 7), (None, 3)] + [(1000, 1001 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in cc.connected_components(spark.createDataFrame(chain, "a long, b long").repartition(5)).collect()}
    assert got == {**dict.fromkeys(range(121), 0), **dict.fromkeys((498, 499, 500), 498), **dict.fromkeys([1000, *range(1001, 1051)], 1000)}


def test_embeddings_match_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 16))
    x = np.vstack([r.normal(size=(400, 16)), base, base + r.normal(size=base.shape) * 0.12, np.repeat(base[:1], 90, 0) + r.normal(size=(90, 16)) * 0.15])
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    p = embedding_dedup.Parameters(leaf=64, block=40, audited=600)
    got = {t["vec_id"]: t for t in embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), p).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    links = near.sum(1) - 1
    assert links.sum() > 3000
    assert sum(got[i]["n_links"] for i in got) >= 0.98 * links.sum() and all(got[i]["n_links"] <= links[i] for i in got)
    assert sum(got[i]["n_links"] != links[i] for i in got) <= 0.02 * len(x)


def test_exponents_and_mixture(spark):
    p = mixing.Parameters(block=400, bucket=5)
    tokens = [9000, 500, 400, 300]
    w = mixing.weights(tokens, mixing.exponent(tokens, mixing.Parameters(repetitions=1e9)))
    assert mixing.entropy(w) == pytest.approx(0.92 * np.log(4), abs=1e-4)
    w = mixing.weights(tokens, mixing.exponent(tokens, p))
    budget = mixing.least_budget(tokens, w)
    assert max(budget * x / t for x, t in zip(w, tokens, strict=True)) == pytest.approx(2.0, abs=1e-3)
    assert mixing.exponent([5, 5], p) == 1.0 and mixing.exponent([7], p) == 1.0 and mixing.shares([], p) == []
    sizes = {"s0": 40, "s1": 9, "s2": 3}
    rows = [(i, s, " ".join(["w"] * (5 + i % 7))) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame([(i, t, s) for i, s, t in rows], "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["epoch"], r["block"]) for r in mixing.mix(df, p).collect())
    assert got == mixed([(i, s, len(t.split())) for i, s, t in rows], p, mixing.shares) and {i for i, _, _ in got} == set(range(52))


def labelled_corpus():
    rows, marks = [], []
    for i in range(240):
        text = prose(i, 60)
        bad, rude = i % 4 == 0, i % 3 == 0
        if bad:
            text = text.replace(" ", "### ")
        if rude:
            text = text.replace(" ", f" {random.Random(i).choice(['idiot', 'moron', 'stupid'])} ", 3)
        rows.append((i, text))
        marks.append((i, int(not bad), int(rude)))
    return rows, marks


def test_quality_and_toxicity_hold_out(spark):
    rows, marks = labelled_corpus()
    docs, labels = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in marks}
    for operator, k, least in ((nbsvm.quality_classifier, 0, 0.95), (toxicity.toxicity, 1, 0.8)):
        out = [r for r in operator(docs, labels).collect() if r["held_out"]]
        assert out and np.mean([r["predicted"] == truth[r["doc_id"]][k] for r in out]) >= least
    model = nbsvm.fit([(0, 0, np.array([1, 2], np.int32).tobytes()), (1, 1, np.array([2, 3], np.int32).tobytes())] * 8, {0: 8, 1: 8}, nbsvm.Parameters(bits=4))
    low, high = model.margins(np.array([0, 0, 1, 1]), np.array([1, 2, 2, 3]), 2)
    assert low < 0 < high


SCORED = [prose(7, 50), prose(8, 60).replace(" ", "### "), "Über stupid ### STUPID Idiot idiot 12 a,b\n\nb  é日本 x'y", "", "!!! ...", "one", prose(3, 9) + " moron" * 5, "naïve " * 30, (prose(1, 400) + "\n") * 300]


def test_scores_match_plain_ones(spark):
    """Both classifiers' vectorised scores against loops over words and n-grams, one text of over half a megabyte included."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows, marks = labelled_corpus()
    truth = {i: (q, t) for i, q, t in marks}
    assert len(SCORED[-1]) > tx.BLOCK_BYTES
    texts = pa.array([*SCORED, None])
    p = nbsvm.Parameters(bits=14)
    sampled = [(i, truth[i][0], nbsvm.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), p.bits)[1].astype(np.int32).tobytes()) for i, t in rows]
    model = nbsvm.fit(sampled, {0: 60, 1: 180}, p)
    found = tx.per_block(texts, lambda d, o: {"s": model.scores(d, o, p.bits)})["s"]
    assert found.tolist() == pytest.approx([quality_score(t, model, p.bits) for t in texts.to_pylist()], abs=1e-9)
    assert found.max() > 0.9 > 0.1 > found[:-2].min()
    p = toxicity.Parameters(bits=14, epochs=3)
    bags = [toxicity.text_bag(np.frombuffer(t.lower().encode(), np.uint8), p) for _, t in rows]
    model = toxicity.fit([(i, truth[i][1], x.tobytes() + v.tobytes()) for (i, _), (x, v) in zip(rows, bags, strict=True)], {0: 160, 1: 80}, p)
    found = tx.per_block(pc.utf8_lower(texts), lambda d, o: {"s": model.scores(d, o, p)})["s"]
    assert found.tolist() == pytest.approx([toxicity_score(t, model, p) for t in texts.to_pylist()], abs=1e-9)
    for (_, t), (x, v) in list(zip(rows, bags, strict=True))[:5]:
        logit = float(v @ model.gain[x]) + model.bias
        assert model.curve(np.array([logit]))[0] == pytest.approx(toxicity_score(t, model, p), abs=1e-6), "bags of the fit and of the scores agree"


def test_samples_keep_to_their_bytes(spark):
    rows = [(i, "w" * (10 + i)) for i in range(40)]
    sample = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, y int")
    featurise = lambda texts: [t.as_py().encode() for t in texts]
    whole = labelled.sampled_features(documents(spark, rows), sample, featurise, 1 << 20)
    assert [(i, y, len(f)) for i, y, f in whole] == [(i, i % 2, 10 + i) for i in range(40)]
    some = labelled.sampled_features(documents(spark, rows), sample, featurise, 400)
    assert {x[:2] for x in some} < {x[:2] for x in whole}
    assert all(0 < sum(len(f) for _, y, f in some if y == c) <= 200 for c in (0, 1))
    least = labelled.sampled_features(documents(spark, rows), sample, featurise, 2)
    assert sorted(y for _, y, _ in least) == [0, 1], "one row of each class stays, however long"


def test_ties_of_ids_and_languages(spark):
    rows, marks = labelled_corpus()
    labels = spark.createDataFrame([*marks, *marks, (0, 1, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    sample, sizes = labelled.class_sample(labels, "toxic", 20)
    assert sample.count() == 40 and sum(sizes.values()) == 240 and sample.where("doc_id = 0 AND y = 0").isEmpty()
    same = spark.createDataFrame([(i, "wort und satz", lang, "s", 1) for i, lang in enumerate(["nl", "de"] * 20)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["lang_pred"], round(r["score"], 9)) for r in language_id.language_id(same, language_id.Parameters(sample_rows=10)).collect()}
    assert got == {("de", 0.5)}, "of equal languages the first wins"


def test_languages_match_plain_version(spark):
    german = "der die und nicht haus strasse garten wasser schnell öffnen über".split()
    rows = [(i, prose(i, 30), "en") for i in range(30)] + [(100 + i, " ".join(random.Random(i).choices(german, k=30)), "de") for i in range(30)]
    asked = [(500, "waters gardening peoples"), (501, "strassen und gaertner übers"), (502, "12 ?"), (503, None), (504, "日本語 x"), (505, "q"), (506, prose(4, 5000))]
    df = spark.createDataFrame(rows + [(i, t, None) for i, t in asked], "doc_id long, text string, lang string")
    p = language_id.Parameters()
    import zlib

    plain = Languages([(t, s) for i, t, s in rows if zlib.crc32(str(i).encode()) % 5], p)
    for r in language_id.language_id(df, p).collect():
        text = next(t for i, t, *_ in [*rows, *asked] if i == r["doc_id"])
        lang, score = plain.predict(text)
        assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(score, abs=1e-9)), r["doc_id"]


def test_misspelt_words_share_grams():
    p = toxicity.Parameters()
    own, other = ({*toxicity.text_bag(np.frombuffer(w, np.uint8), p)[0].tolist()} for w in (b"stupid", b"stuupid"))
    assert len(own & other) >= 4


def test_language_backoff(spark):
    rows = [(i, prose(i, 40)) for i in range(40)]
    other = [(100 + i, " ".join(random.Random(i).choices("der die und nicht haus strasse garten wasser schnell".split(), k=40))) for i in range(40)]
    df = documents(spark, rows).unionByName(documents(spark, other).selectExpr("doc_id", "text", "'de' AS lang", "source", "n_chars"))
    asked = documents(spark, [(500, "waters gardening peoples"), (501, "strassen und gaertner"), (502, "¿? 12")])
    model = df.unionByName(asked.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars"))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(model).collect()}
    assert (got[500], got[501], got[502]) == ("en", "de", "und") and all(got[i] == ("en" if i < 100 else "de") for i in got if i < 500)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body class="has-sidebar"><header><h2>Site name</h2></header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div id="cookie-banner">We use cookies</div>%s<aside>Side</aside><section class="comments"><article class="comment"><p>A reader writes a long comment here, long enough to look like text.</p></article></section>
<form><p>Your mail</p><input></form><footer>&copy; us</footer></body></html>"""
BODY = "<h1>Head line</h1><p>First   paragraph &amp; more<br>of it, which is long enough to be content.<p>Short.<div class='ad'>Buy!</div><p>Last paragraph <b>with bold</b> and a <a href=y>link</a>, long enough as well.</p>"
WANT = "Head line\nFirst paragraph & more of it, which is long enough to be content.\nShort.\nLast paragraph with bold and a link, long enough as well."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class='content with-sidebar'>%s</div>"])
def test_article_text(wrap):
    assert html_text.main_text(PAGE % (wrap % BODY)) == WANT


LONG = [f"{c}word " * 82 + f"{c}end" for c in "abcdef"]
TEXT = "".join(f"<p>{t}</p>" for t in LONG)
READERS = "".join(f"<div class='comment'><p>{t} {t} {t}</p></div>" for t in LONG)
PAGES = {
    "a headline in the article's header": (f"<article><header class='entry-header'><h1>Head</h1></header>{TEXT}</article>", ["Head", *LONG]),
    "headers by class in an article": (f"<nav><a href='x'>Menu</a></nav><article><div class='article-header'><h1>Head</h1></div><h2 class='section-header'>Part</h2>{TEXT}</article>", ["Head", "Part", *LONG]),
    "adverts as paragraphs": (f"<article><h1>Head</h1><p class='advert'>Buy this now</p>{TEXT}<p class='ad sponsored'>Paid for</p></article>", ["Head", *LONG]),
    "a layout's name around all": (f"<div class='sidebar-layout'><div class='x'><h1>Head</h1>{TEXT}</div><div class='sidebar'><p>Beside it</p></div></div>", ["Head", *LONG]),
    "a layout's name around the article": (f"<div>A tag line</div><div class='sidebar-layout'><article><h1>Head</h1>{TEXT}</article><div class='sidebar'><p>Beside it</p></div></div>", ["Head", *LONG]),
    "paragraphs beside containers": ("<p>Only text</p><nav><a href='x'>m</a></nav><div>a longer text that goes on for a while</div>", ["Only text", "a longer text that goes on for a while"]),
    "more comments than article": (f"<article><h1>Head</h1>{TEXT}</article><section class='comments'>{READERS}</section>", ["Head", *LONG]),
    "more comments than text": (f"<div class='post'><h1>Head</h1>{TEXT}</div><div id='comments'>{READERS}</div>", ["Head", *LONG]),
    "a short article and a long notice": (f"<article><h1>Head</h1><p>Short.</p></article><div class='cookie-banner'>{'We use cookies. ' * 9}</div><footer>us</footer>", ["Head", "Short."]),
    "a related part that is text": (f"<article><h1>Head</h1>{TEXT}<section class='related-work'><p>{LONG[0]}</p></section></article><div class='related'><a href='x'>One</a><a href='y'>Two</a></div>", ["Head", *LONG, LONG[0]]),
    "unmarked lines outside the article": (f"<div class='x7'>Win a prize today</div><article><h1>Head</h1>{TEXT}</article><div class='x8'>Call us</div>", ["Head", *LONG]),
    "a site's header and notice": (f"<header><h2>Site</h2></header><div class='notice'>Down on Sunday.</div><div class='content'><h1>Head</h1>{TEXT}</div>", ["Head", *LONG]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_as_wanted(name):
    page, want = PAGES[name]
    page = f"<html><head><title>T</title></head><body>{page}</body></html>"
    assert html_text.main_text(page).split("\n") == want == article(page, html_text).split("\n")


def random_page(r):
    names = ["", "", "", "post", "ad", "sidebar", "comments", "share-bar", "has-sidebar", "entry-header", "notice", "related"]

    def element(depth):
        tag = r.choice(["div", "section", "p", "article", "ul", "nav", "aside", "header", "h2", "blockquote", "p", "p"] if depth < 4 else ["p", "h3", "b"])
        text = " ".join(r.choices(["word", "longer", "of", "&amp;", "sentences"], k=r.choice([1, 3, 8, 40, 90])))
        if tag in ("p", "h2", "h3", "b"):
            inner = r.choice([text, f"{text} <b>bold</b> {text}", f"<a href='x'>{text}</a>", f"{text}<script>no()</script>"])
        else:
            inner = r.choice(["", text]) + "".join(element(depth + 1) for _ in range(r.randint(1, 4)))
        name = r.choice(names)
        return f"<{tag}{f' class={chr(39)}{name}{chr(39)}' if name else ''}>{inner}</{tag}>"

    return f"<html><body>{''.join(element(0) for _ in range(r.randint(1, 5)))}</body></html>"


def test_random_pages_match_plain_version(monkeypatch):
    pages = [random_page(random.Random(seed)) for seed in range(300)]
    found = [html_text.main_text(p) for p in pages]
    assert found == [article(p, html_text) for p in pages] and sum(map(bool, found)) > 200
    monkeypatch.setattr(html_text, "threshold", lambda values: -1.0)
    assert sum(html_text.main_text(p) != t for p, t in zip(pages, found, strict=True)) > 100, "the threshold decides"


def test_long_and_unclosed_pages():
    for page, want in (("<span>x" * 100_000 + "<p>y</p>" * 500, 501), ("<div>" * 50_000 + "x", 1), ("<a href=x>y" * 30_000, 1), ("<div>" + "<b>x<p>y" * 20_000, 20_001)):
        assert html_text.main_text(page).count("\n") + 1 == want


def test_smoothing_and_threshold():
    assert html_text.smoothed(np.full(9, 3.0), 1.5) == pytest.approx(np.full(9, 3.0))
    assert 2 < html_text.threshold(np.array([1.0, 2, 1.5, 90, 100])) < 90 and html_text.threshold(np.array([4.0])) == 4.0


def groups_found(spark, x, p):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return {t["vec_id"]: (t["n_links"], t["component_id"]) for t in embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), p).collect()}


def groups_wanted(x, threshold=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    root = components(range(len(x)), lambda a, b: near[a, b])
    return {i: (int(near[i].sum()) - 1, root[i]) for i in range(len(x))}


@pytest.mark.parametrize(("noise", "p"), [(0, embedding_dedup.Parameters()), (900, embedding_dedup.Parameters(leaf=64, block=64))])
def test_links_between_groups_larger_than_a_list(spark, noise, p):
    r = np.random.default_rng(3)
    a, b = np.linalg.qr(r.normal(size=(64, 2)))[0].T
    centres = np.vstack([np.repeat([a], 15, 0), np.repeat([0.93 * a + np.sqrt(1 - 0.93**2) * b], 15, 0)])
    x = np.vstack([centres + r.normal(size=(30, 64)) * 0.002, r.normal(size=(noise, 64))])
    want = groups_wanted(x)
    assert want[0] == (29, 0) and want[29] == (29, 0)
    assert groups_found(spark, x, p) == want


def hot_and_pairs():
    """A third of the rows in one group, and pairs just above the threshold among others."""
    r = np.random.default_rng(8)
    pairs = r.normal(size=(60, 64))
    pairs /= np.linalg.norm(pairs, axis=1, keepdims=True)
    other = r.normal(size=pairs.shape)
    other -= (other * pairs).sum(1, keepdims=True) * pairs
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return np.vstack([r.normal(size=64) + r.normal(size=(150, 64)) * 0.1, pairs, 0.91 * pairs + np.sqrt(1 - 0.91**2) * other, r.normal(size=(180, 64))])


def test_small_groups_beside_a_hot_one_are_audited(spark):
    x = hot_and_pairs()
    assert groups_found(spark, x, embedding_dedup.Parameters(leaf=4, block=16, trees=1, rounds=0, attempts=1)) == groups_wanted(x)


def test_saturated_lists_grow(spark):
    r = np.random.default_rng(5)
    x = np.vstack([r.normal(size=32) + r.normal(size=(16, 32)) * 0.05, r.normal(size=(40, 32))])
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes()), i) for i, v in enumerate(x)], "node long, v binary, root long").repartition(3)
    lists, met = embedding_dedup.descend(nodes, None, "<f8", len(x), 0, 1, embedding_dedup.Parameters(neighbours=4, longest=16))
    found = {}
    for t in lists.collect():
        found.setdefault(t["u"], set()).add(t["v"])
        assert t["k"] == 16 and t["worst"] == -2.0, "a list that holds all links isn't full any more"
    assert found == {i: {*range(16)} - {i} for i in range(16)}
    root = {t["node"]: t["root"] for t in cc.connected_components(met).collect()}
    assert root == dict.fromkeys(range(16), 0)
    full = embedding_dedup.descend(nodes, None, "<f8", len(x), 0, 1, embedding_dedup.Parameters(neighbours=4, longest=8))[0]
    assert {t["worst"] >= 0.9 for t in full.collect()} == {True}, "at its longest a saturated list stays so"


def test_large_components_by_blocks(spark):
    """A chain of groups, 5,000 vectors in one component, against brute force; some blocks link as a whole."""
    r = np.random.default_rng(6)
    axes = np.linalg.qr(r.normal(size=(24, 2)))[0].T
    angles = np.repeat(np.arange(25) * 0.1, 200) + r.normal(size=5000) * 0.004
    x = np.cos(angles)[:, None] * axes[0] + np.sin(angles)[:, None] * axes[1] + r.normal(size=(5000, 24)) * 0.002
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [int((unit[i] @ unit.T >= 0.9).sum()) - 1 for i in range(5000)]
    got = groups_found(spark, x, embedding_dedup.Parameters())
    assert [got[i] for i in range(5000)] == [(n, 0) for n in want]
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes()), 1) for i, v in enumerate(x)], "node long, v binary, copies long")
    members = embedding_dedup.blocks_of(nodes.selectExpr("node", "0L AS root"), nodes, "<f8", embedding_dedup.Parameters())
    pairs = embedding_dedup.block_pairs(members.cache(), "<f8", embedding_dedup.Parameters())
    kinds = {t["whole"]: t["n"] for t in pairs.groupBy("whole").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    blocks = members.select("block").distinct().count()
    every = blocks * (blocks + 1) // 2
    print("blocks", blocks, "pairs", every, kinds)
    assert kinds[True] > 0 and kinds[False] < 0.6 * every, "bounds settle blocks that all link, and those that don't"


def test_all_vectors_meet_in_parts(spark):
    x = hot_and_pairs()
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "node long, v binary").repartition(3)
    forest = embedding_dedup.exact_forest(nodes, "<f8", len(x), embedding_dedup.Parameters(exact=100))
    root = {r["node"]: r["root"] for r in cc.connected_components(forest).collect()}
    assert {i: root.get(i, i) for i in range(len(x))} == {i: c for i, (_, c) in groups_wanted(x).items()}


@pytest.mark.parametrize("tags", [6, 20, 40])
def test_article_text_of_low_regions_stays(tags):
    head = "<i></i>" * tags
    long = [(f"{c}word " * 83).strip() for c in "abcdef"]
    short = [f"{c} " + "brief words " * 7 for c in "uvwxy"]
    sections = f"<body>{head}<div><h1>First</h1>{''.join(f'<p>{t}</p>' for t in long)}</div><div><h2>Second</h2>{''.join(f'<p>{t}</p>' for t in short)}</div></body>"
    assert html_text.main_text(sections).split("\n") == ["First", *long, "Second", *(t.strip() for t in short)]
    quote = "a quotation of some sixty characters between two paragraphs"
    quoted = f"<body>{head}<p>{long[0][:400]}</p><blockquote>{quote}</blockquote><p>{long[1][:400]}</p></body>"
    assert quote in html_text.main_text(quoted)
    links = "".join(f"<p><a href=x>Link number {i}</a></p>" for i in range(8))
    assert "Link number" not in html_text.main_text(f"<body><div>{''.join(f'<p>{t}</p>' for t in long)}</div><div>{links}</div></body>")
    beside = f"<body><div>{''.join(f'<p>{t}</p>' for t in long)}</div><article><p>A teaser.</p></article></body>"
    assert long[0] in html_text.main_text(beside)
