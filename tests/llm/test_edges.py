"""Hard cases of the numbered operators: sizes, borders between rows, rows without identity, clashing names."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import components, edit_distance_in
from pyspark.sql import functions as F

from meshloom.llm import chat, decontaminate, langid, neardup, pii, quality, tokens, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
#: Names that the operators use inside.
CLASHING = ("__spans", "__hash", "__id", "__key", "hash", "id", "none", "row", "row_hash", "text_hash", "spans", "label")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# tokens


def same_as_library(coder, texts):
    return [x.tolist() for x in coder.encode(texts)] == [coder.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_distinct_pieces_after_another_text():
    coder = tokens.Encoder(tokens.default_vocabulary())
    assert same_as_library(coder, ["before", " ".join(str(7919 * i) for i in range(700_000)), "after"])


def test_table_size_changes_no_ids():
    coder = tokens.Encoder(tokens.default_vocabulary())
    coder.known = 3
    rng = random.Random(1)
    assert same_as_library(coder, [" ".join(rng.choice(["one's", "2", "drei", " ", "\n\n", "é🙂"]) + str(rng.randrange(50)) for _ in range(40)) for _ in range(30)])


def test_keys_that_want_one_slot_keep_their_ids(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_BITS", 1)
    coder = tokens.Encoder(tokens.default_vocabulary())
    rng = random.Random(3)
    for _ in range(20):
        assert same_as_library(coder, [" ".join(rng.choice(["a", "B2", "é", "\n"]) + str(rng.randrange(2000)) for _ in range(60)) for _ in range(3)])
        assert len(coder.slots) >= 2 * coder.n_keys


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_CHARS", 7)
    coder = tokens.Encoder(tokens.default_vocabulary())
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B", "é", "1", "'s", "'ll", " ", "  ", "\n", " ", "…", "\x1c"]) for _ in range(rng.randrange(120))) for _ in range(300)]
    assert same_as_library(coder, texts)


def test_other_pre_tokenizers_are_left_to_the_library(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    plain.save(str(tmp_path / "words.json"))
    assert same_as_library(tokens.Encoder(str(tmp_path / "words.json")), ["a b  c", "", "b"])


# language models


def trained(spark):
    return langid.train(documents(spark))


def test_scores_do_not_depend_on_neighbours(spark):
    model = trained(spark)
    texts = ["d", "le", "das haus", None, "x" * 50, "la casa, el perro", "the", "é"]
    alone = [model.cross_entropies(pa.array([t], pa.string()))[0][0] for t in texts]
    rng = random.Random(3)
    for _ in range(20):
        order = rng.sample(range(len(texts)), len(texts))
        beside, _ = model.cross_entropies(pa.array([texts[k] for k in order], pa.string()))
        assert all(np.allclose(alone[k], beside[j], atol=1e-12) for j, k in enumerate(order))


def plain_model(texts):
    """Interpolated Kneser-Ney of one language in dictionaries, with the discounts of the operator."""
    def clean(t):
        return " " + "".join(c if c.isalpha() else " " for c in t.lower())
    counts = [Counter() for _ in range(5)]
    for t in texts:
        s = "   " + " ".join(clean(t + " ").split(" ")).replace("  ", " ")
        while "  " in s[3:]:
            s = s[:3] + s[3:].replace("  ", " ")
        for k in range(4, len(s)):
            counts[4][s[k - 3 : k + 1]] += 1
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    return counts


def test_probabilities_equal_a_plain_kneser_ney(spark):
    texts = ["the cat sat on the mat", "a cat and a hat", "that is the hat of the cat", "sat on a mat"]
    rows = [(4 * i + 1, t, "en", "s") for i, t in enumerate(texts)]
    frame = spark.createDataFrame([("en", t) for _, t, _, _ in rows], "lang string, text string").coalesce(1)
    table = frame.mapInArrow(langid._gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    model, counts = langid.Model(table), plain_model(texts)
    key = lambda g: sum(ord(c) << 16 * k for k, c in enumerate(reversed(g)))
    assert Counter({langid_gram: n for langid_gram, n in zip(table["gram"], table["n"], strict=True)}) == Counter({key(g): n for g, n in counts[4].items()})
    vocabulary = len(counts[1]) + 1

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / vocabulary
        table = counts[n]
        ones, twos = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        following = [v for h, v in table.items() if h[:-1] == g[:-1]]
        if not following:
            return p(g[1:])
        own = max(table.get(g, 0) - discount, 0) / sum(following)
        return own + discount * len(following) / sum(following) * p(g[1:])

    for g in ["the ", " cat", "  th", "hat ", "zzzz", "thez", "   a", "on t", "qthe"]:
        assert math.isclose(float(model.log_probs(np.array([key(g)], np.uint64))[0][0]), math.log(p(g)), abs_tol=1e-9), g


# near-duplicates


def test_small_sets_lose_no_link(spark):
    rng, rows = random.Random(4), []
    for i in range(1500):
        words = [f"w{i}_{k}" for k in range(8)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: rng.choice([7, 8])]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


def odd_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, "only here and nowhere else"), (None, "only here and nowhere else"), (3, None), (3, ""), (4, "q r s t u v")]
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], DOCS).withColumns({c: F.lit(7) for c in CLASHING})


def test_pivots_of_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS", 3)
    rng, base = random.Random(5), [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[:at], f"x{i}", *base[at + 1 :]])) for i in range(60) for at in [rng.randrange(60)]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


def test_one_of_each_of_odd_rows(spark):
    docs = odd_rows(spark)
    out = neardup.one_of_each(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter({(1, "a b c d e f g"): 2, (None, "only here and nowhere else"): 2, (3, None): 1, (3, ""): 1, (4, "q r s t u v"): 1})
    assert neardup.one_of_each(docs.limit(0)).isEmpty()


# quality


def test_rejection_is_by_row(spark):
    rng = random.Random(6)
    good = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(80))
    rows = [(1, good, "en", "s"), (1, "too short", "en", "s"), (None, "too short", "en", "s"), (None, good, None, None), (2, None, "en", "s"), (2, good, "", "")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in CLASHING})
    out = quality.reject(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(1, good), (None, good), (2, good)])
    assert quality.reject(docs.limit(0)).isEmpty()


# chat


@pytest.mark.parametrize("alternate", [True, False])
def test_long_conversations_take_linear_work(spark, alternate):
    n, roles = 100_000, ["user", "assistant"] if alternate else ["assistant"]
    text = lambda i: ["", "é🙂 " * (i % 9), "[SEP] </s> x"][i % 3]
    rows = spark.createDataFrame([(1, i, roles[i % len(roles)], text(i)) for i in range(n)], "conv_id long, turn long, role string, text string")
    start = time.monotonic()
    out = chat.read_conversations(chat.format_conversations(rows)).collect()
    assert time.monotonic() - start < 60
    assert [tuple(t) for t in out[0]["turns"]] == [(roles[i % len(roles)], text(i)) for i in range(n)]
    assert list(out[0]["loss_texts"]) == [text(i) for i in range(n) if roles[i % len(roles)] == "assistant"]


def test_texts_across_chunks_are_read_whole(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choice("aé🙂") for _ in range(rng.choice([0, 1, chat.CHUNK - 1, chat.CHUNK, 3 * chat.CHUNK + 5])))) for c in range(6) for t in range(8)]
    got = {r["conv_id"]: list(r["loss_texts"]) for r in chat.read_conversations(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {c: [t for d, _, role, t in rows if d == c and role == "assistant"] for c in range(6)}


# personal data


def prose_rows():
    rng = random.Random(8)
    unlike = lambda: f"E-{rng.randrange(10**5):05d}"
    rows = [(i, f"As asked, my employee number is {'%020x' % rng.getrandbits(79)}a1, thank you {i}.") for i in range(40)]
    rows += [(100 + i, f"Hello, my employee number is {unlike()}. Regards") for i in range(4)]
    # words that stand before data of all kinds, and before numbers
    mixed = ["a@b.com", "10.0.0.7", "+1 (303) 555-0100", "4111 1111 1111 1111"]
    rows += [(200 + i, f"it is of the {mixed[i % 4].replace('0', str(i % 10))} here") for i in range(24)] + [(300 + i, f"it is of the {1000 + i} here") for i in range(3)]
    return rows


def added(rows, found):
    text = dict(rows)
    return {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "secret"] for r in found}


def test_prose_contexts_find_unseen_identifiers(spark):
    rows = prose_rows()
    got = added(rows, pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(got[100 + i] == [rows[40 + i][1].split("is ")[1].split(".")[0]] for i in range(4))
    assert all(len(got[i]) == 1 for i in range(40)) and not any(got[300 + i] for i in range(3))


@pytest.mark.parametrize("blank", [" ", " " * 60, "\n" * 100, " \t\n" * 1000], ids=["one", "60", "100 lines", "3000"])
def test_contexts_over_any_blanks(spark, blank):
    text = f"my{blank}employee{blank}number{blank}is{blank}AB12345{blank}thanks"
    found = [p for p, *_ in pii.prose_values(text, {})]
    assert found == ["number is _", "employee number is _", "number is _ thanks"]
    rows = [(i, t.replace("number is ", f"number{blank}is{blank}")) for i, t in prose_rows()]
    got = added(rows, pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(len(got[100 + i]) == 1 for i in range(4)) and all(len(got[i]) == 1 for i in range(40))


def test_blanks_before_values_are_walked_once():
    start = time.monotonic()
    for t in ("a b" + " " * 300_000 + "1abcd ", "a" + " \n" * 100_000 + "b " * 3 + "x1234 " * 20_000, ("ab cd" + " " * 50 + "x1234 ") * 5_000, " " * 300_000 + "x1234", "ab " * 100_000 + "x1234"):
        pii.found_values(t, [])
    assert time.monotonic() - start < 20


def template_documents(n, seed=11, words=12):
    """n documents of 12 sentences in order, drawn from 18."""
    rng = random.Random(seed)
    sentences = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(words)) for _ in range(18)]
    return [(i, " ".join(sentences[k] for k in sorted(rng.sample(range(18), 12)))) for i in range(n)]


def pairs_compared(spark, monkeypatch, rows):
    """The result of near-dedup, and how many pairs met the exact test."""
    counted, plain = [], neardup.verified

    def counting(pairs, *args):
        counted.append(pairs.count())
        return plain(pairs, *args)

    monkeypatch.setattr(neardup, "verified", counting)
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}, sum(counted)


def test_documents_of_the_same_passages(spark, monkeypatch):
    """Far from all pairs are compared, and no link is lost."""
    found = {}
    for n in (300, 600):
        got, found[n] = pairs_compared(spark, monkeypatch, template_documents(n))
        assert got == components(template_documents(n))
    assert found[600] < found[300] * 2**1.3


def test_large_sets_at_the_threshold_are_linked(spark):
    """Pairs of sets of 600 to 3,000 shingles just at, and just below, 0.75."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for k in range(40):
        both = [word() for _ in range(604 + 60 * k)]
        own = (len(both) - 4) // 3
        own -= own * 3 > len(both) - 4
        rows += [(3 * k, " ".join(both)), (3 * k + 1, " ".join(both + [word() for _ in range(own)])), (3 * k + 2, " ".join(both + [word() for _ in range(own + 1)]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = components(rows)
    assert got == want and all(want[3 * k + 1][1] == 3 * k for k in range(40))


def test_pattern_scores_equal_plain_rounds(spark):
    rows = prose_rows() + [(400 + i, f"api_key = '{'%016x' % (i * 7**20)}b' and token: {'%016x' % (i * 7**20)}b") for i in range(12)] + [(500 + i, f"token: word{i}") for i in range(3)]
    edges = defaultdict(dict)
    for _, text in rows:
        for pattern, instance, kind, _, _ in pii.found_values(text, pii.base_spans(text)):
            if pattern is not None:
                edges[pattern][instance] = max(kind, edges[pattern].get(instance, 0))
    edges = {p: x for p, x in edges.items() if sum(k > 0 for k in x.values()) >= pii.LEAST_SEEDS}
    scores = {p: {i: float(k > 0) for i, k in x.items()} for p, x in edges.items()}
    for turn in range(pii.ROUNDS):
        confidence = {p: sum(s.values()) / (len(s) + 1) for p, s in scores.items()}
        if turn == pii.ROUNDS - 1:
            break
        speaks = {p: 1 - min(c, 0.999) if c >= pii.SPEAKS else 1.0 for p, c in confidence.items()}
        scores = {p: {i: 1.0 if k else 1 - math.prod(speaks[q] for q, y in edges.items() if q != p and i in y) for i, k in x.items()} for p, x in edges.items()}
    scanned = pii.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["pattern"]: r for r in pii.score_patterns(scanned).collect()}
    assert set(got) == set(confidence)
    for p, c in confidence.items():
        kinds = [k for k in edges[p].values() if k]
        assert (got[p]["instances"], got[p]["seeds"]) == (len(edges[p]), len(kinds))
        assert math.isclose(got[p]["confidence"], c, abs_tol=1e-9) and math.isclose(got[p]["share"], max(Counter(kinds).values()) / len(kinds))


def test_nothing_of_a_long_secret_is_left(spark):
    rng = random.Random(9)
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(10_000))
    name = "the_name_of_this_key_is_longer_than_thirty_two_characters_and_goes_on"
    rows = [(i, f"{name} = '{i:02d}aabbccddeeff0011'") for i in range(8)] + [(50, f"{name} = '{secret}'"), (51, f"xoxb-{'a1-' * 200}z and sk-{'Ab1' * 300}."), (None, f"{name}={secret[:500]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASHING}).withColumn("n_chars", F.length("text"))
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[50]["text"] == f"{name} = '[SECRET]'" and got[51]["text"] == "[SECRET] and [SECRET]." and got[None]["text"] == f"{name}=[SECRET]"
    assert all(r["n_chars"] == len(r["text"]) and r["__spans"] == 7 for r in got.values())


# decontamination


def test_cleaning_is_by_row(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None)], "item_id long, text string")
    rows = [(1, "see: The quick brown fox jumped over the lazy dog!"), (1, "nothing of the kind"), (None, "the quick brown fox jumps over the lazy dog"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASHING})
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(rows[k] for k in (1, 3, 4))
    assert decontaminate.clean(docs.limit(0), bench).isEmpty() and decontaminate.clean(docs, bench.limit(0)).count() == 5


def test_short_items_with_an_edit_are_found_and_verified(spark):
    rng = random.Random(10)
    words = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 15)))) for i in range(40)]
    docs = [(d, " ".join(rng.choice(words) for _ in range(30))) for d in range(60)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if edit_distance_in(x.split(), t.split()) <= len(x.split()) // 4}


# url filters


def test_rules_from_a_table_in_several_blocks(spark, monkeypatch):
    rng = random.Random(11)
    names = [f"n{i}" for i in range(40)]
    host = [(rng.choice(["allow", "block"]), f"{rng.choice(names)}.{rng.choice(['org', 'net'])}/{rng.choice(['', 'a/', 'a/b', 'c'])}") for _ in range(150)]
    host = list({t: (v, t) for v, t in host}.values())
    pattern = [("block", f"/{n}^") for n in names[:20]] + [("allow", f"/{n}/keep") for n in names[:5]] + [("block", "*x*")]
    pages = [(i, f"https://{rng.choice(['www.', ''])}{rng.choice(names)}.{rng.choice(['ORG', 'net'])}/{rng.choice(['a/b/', 'c', ''])}{rng.choice(names)}{rng.choice(['/keep', '', '/', 'x'])}") for i in range(400)] + [(900, None), (901, "no scheme"), (902, "http://" + "n1." * 20_000 + "org/a/" + "y" * 300_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("rule", F.lit(1))
    rules = spark.createDataFrame([("host", v, t) for v, t in host] + [("pattern", v, t) for v, t in pattern], "kind string, verdict string, text string")
    given = lambda **k: sorted(map(repr, urls.judge(frame, **k).collect()))
    want = given(host_rules=sorted(host, key=lambda r: (r[1], r[0])), pattern_rules=sorted(pattern, key=lambda r: (r[1], r[0])))
    plain = {}
    for i, url in pages:
        h, p = urls.split_url(url)
        fits = [(t, v) for v, t in host if p and (h == t.partition("/")[0] or h.endswith("." + t.partition("/")[0])) and p.startswith("/" + t.partition("/")[2])]
        plain[i] = max(fits, key=lambda f: len(f[0]), default=(None,))[0]
    assert {r["page_id"]: r["rule"] for r in urls.judge(frame, rules=rules).collect()} == plain
    assert given(rules=rules) == want
    monkeypatch.setattr(urls, "BLOCK_RULES", 120)
    assert given(rules=rules) == want
    assert {r["verdict"] for r in urls.judge(frame, rules=rules.limit(0)).collect()} == {"allow"}
