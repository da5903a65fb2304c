"""Problems 3, 5, 6, 8, 9, 10."""

import random
from collections import defaultdict

import numpy as np
import pytest

from leafmill.llm import near_duplicates as N
from leafmill.llm import packing, quality, subjects, tokens

CONV = "result_id long, url string, md_content string, word_count long, domain string"
PAGE = "url string, domain string, content_type string"
DOC = "doc_id long, text string, ids string"
WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu na pe ri so tu".split() for b in "len mor sta dir von tal ras pim gan tek".split()]


def article(rng, n=200):
    return " ".join("The " + " ".join(rng.choice(WORDS) for _ in range(6)) + " was in the " + rng.choice(WORDS) + "." for _ in range(n // 10))


def tables(spark, texts, hosts=3):
    rows = [(i, f"https://s{i % hosts}.com/{i}", t, 1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows, (None, None, "x", None, None), (7777, None, None, None, None)], CONV), spark.createDataFrame([(u, f"s{i % hosts}.com", "html") for i, u, *_ in rows], PAGE)


# ---- 5 ------------------------------------------------------------------------


def variants():
    rng = random.Random(3)
    base = [article(rng) for _ in range(12)]
    texts = list(base)
    for b in base[:8]:
        words = b.split(" ")
        for share in (0.01, 0.04, 0.08, 0.2):
            texts.append(" ".join(rng.choice(WORDS) if rng.random() < share else w for w in words))
    return [*texts, base[0], base[0], "short text", "", "a " * 50_000]


def brute_pairs(texts):
    sets = [N.Shingles()(t) for t in texts]
    out = set()
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a is not None and b is not None and len(np.intersect1d(a, b)) * 2 >= len(np.union1d(a, b)):
                out.add((i, j))
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_pairs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    texts = variants()
    c, p = tables(spark, texts)
    found = [tuple(r) for r in N.linked_pairs(c, p).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_pairs(texts)


def test_groups(spark):
    texts = variants()
    c, p = tables(spark, texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(texts):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["result_id"]: r["group_id"] for r in N.article_groups(c, p).collect()}
    long_enough = {i for i, t in enumerate(texts) if len(t.split()) >= 80}
    assert got == {i: root(i) for i in long_enough}


def test_gray_index_finds_all_close_pairs():
    rng = np.random.default_rng(1)
    high, low = (rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in range(2))
    high[100:200] = high[:100] ^ np.uint64(5)
    low[100:200] = low[:100]
    shard = np.repeat([3, 9, 9], 100)
    shard[:100] = shard[100:200] = 3
    found = {tuple(sorted(p)) for a, b in N.GrayIndex(shard, high, low).close_pairs(50) for p in zip(a.tolist(), b.tolist())}
    wanted = {(i, j) for i in range(300) for j in range(i + 1, 300) if shard[i] == shard[j] and bin(int(high[i] ^ high[j])).count("1") + bin(int(low[i] ^ low[j])).count("1") <= 50}
    assert found == wanted and (0, 100) in found
    codes = np.arange(16, dtype=np.uint64)
    zeros = np.zeros(16, np.uint64)
    assert sorted(range(16), key=lambda i: N.gray_rank(zeros.copy(), codes.copy())[1][i]) == [i ^ (i >> 1) for i in range(16)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 102), (101, 102)]
    got = {r["text_id"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in (100, 101, 102)}
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 3 and 6 ------------------------------------------------------------------


def mixed():
    rng = random.Random(5)
    texts = {f"prose{i}": "# A title\n\n" + article(rng) for i in range(30)}
    texts |= {
        "short": "# A title\n\n" + article(rng, 20),
        "missing": "# Page not found\n\nThe page could not be located. Please try again later.",
        "script": "Please enable JavaScript to view this page.",
        "filler": "# Title\n\nLorem ipsum dolor sit amet consectetur adipiscing elit. Sed tempor magna aliqua nulla.",
        "slots": "{{ title }}\n\n{{ body_text }}\n\n${name} ${value}",
        "unfilled": "# {{title}}\n\n" + " ".join(w + (" #{name}" if i % 9 == 0 else " __DATE__" if i % 13 == 0 else "") for i, w in enumerate(article(rng).split())),
        "mentions a slot": "# On forms\n\n" + article(rng) + " A field such as {{name}} was filled in later.",
        "code": "# On code\n\n" + article(rng) + "\n\n```\n{{ a }} {{ b }} ${c} undefined NaN null [object Object] {0} {1}\n```",
        "years": "# Wrapped\n\n" + "\n".join(f"{1900 + i}. The {rng.choice(WORDS)} was in the {rng.choice(WORDS)} and had the {rng.choice(WORDS)} with all of it in" for i in range(12)),
        "quotes": "# On errors\n\n" + article(rng) + ' The site said "Page not found" and "Please enable JavaScript".',
        "list": "# Things\n\n" + "\n".join(f"- {rng.choice(WORDS)} {rng.choice(WORDS)}, {i} g" for i in range(40)),
        "plain list": "# Things\n\n" + "\n".join(f"{rng.choice(WORDS)} {rng.choice(WORDS)}, {i} g" for i in range(40)),
        "table": "# Data\n\n| a | b |\n| --- | --- |\n" + "\n".join(f"| {rng.choice(WORDS)} | {i} |" for i in range(40)),
        "csv": "# Data\n\n" + "\n".join(f"{rng.choice(WORDS)};{rng.choice(WORDS)};{i};{i * 7}" for i in range(40)),
        "hex": " ".join("%032x" % rng.getrandbits(128) for _ in range(40)),
        "stuffing": " ".join(rng.choice(("buy", "cheap", "best", *WORDS)) for _ in range(200)),
        "wrapped": "# W\n\n" + "\n".join(article(rng)[k : k + 66] for k in range(0, 1000, 66)),
        "empty": "",
    }
    return texts


def test_residue_and_types(spark):
    texts = mixed()
    names = list(texts)
    c, p = tables(spark, list(texts.values()), hosts=5)
    residue = [r[0] for r in quality.residue_results(c, p).collect()]
    assert sorted(names[i] for i in residue) == ["filler", "missing", "script", "slots", "unfilled"]
    kinds = [(names[r["result_id"]], r["body_kind"]) for r in quality.not_prose(c, p).collect()]
    assert sorted(kinds) == [("csv", "table"), ("hex", "junk"), ("list", "list"), ("plain list", "list"), ("stuffing", "junk"), ("table", "table")]
    assert quality.articles_only(c, p).where("result_id is not null").select("result_id").distinct().count() == len(texts) + 1 - 5
    stats = {r["result_id"]: r for r in quality.text_statistics(c).collect()}
    assert stats[names.index("empty")]["word_count"] == 0 and stats[names.index("list")]["word_count"] == 1 + 3 * 40 + 40
    none = c.limit(0), p.limit(0)
    assert quality.residue_results(*none).count() == quality.not_prose(*none).count() == quality.text_statistics(none[0]).count() == 0


def test_accuracies_are_learned():
    rng = np.random.default_rng(0)
    truth = rng.choice(4, 4000, p=[0.6, 0.15, 0.15, 0.1])
    right = (0.95, 0.9, 0.55, 0.85)
    votes = np.stack([np.where(rng.random(4000) < a, truth, rng.integers(0, 5, 4000)) for a in right], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    guess = quality.learn_accuracies(patterns, counts).argmax(axis=1)[inverse.ravel()]
    assert (guess == truth).mean() > 0.95


def test_templates_of_a_leaf():
    assert quality.merge_leaf(["quote the <*> now please", "quote the code now please", "quote all of it never"]) == ["quote the <*> now please"] * 2 + ["quote all of it never"]


def test_a_short_article_on_50_hosts_is_no_message(spark):
    """Copies have one text beside each sentence; a notice that no phrase list knows stands beside different ones."""
    rng = random.Random(7)
    copy = "# A title\n\n" + article(rng, 60)
    notice = "Members of the club can read all of it after they sign in at the door."
    texts = [copy] * 50 + [f"# {rng.choice(WORDS)} {rng.choice(WORDS)} {rng.choice(WORDS)}\n\n{notice}" for _ in range(50)]
    c, p = tables(spark, texts, hosts=50)
    assert sorted(r[0] for r in quality.residue_results(c, p).collect()) == list(range(50, 100))


def test_a_verdict_holds_for_all_sentences_of_a_template(spark):
    """Each sentence is on one page; what most of a template's say is said of the one that says it in no listed words."""
    texts = [f"The request ended in a server error near {w} today, dear friends." for w in WORDS[:8]]
    texts += [f"The request ended in a tunnel error near {WORDS[20]} today, dear friends."]
    texts += [f"The request came from a quiet town near {WORDS[21]} many years ago."]
    c, p = tables(spark, texts)
    assert sorted(r[0] for r in quality.residue_results(c, p).collect()) == list(range(9))


def test_a_long_page_of_messages(spark):
    """However long, a body of messages is residue; a long article that tells of some is not."""
    rng = random.Random(9)
    messages = " ".join(f"Access denied to the {rng.choice(WORDS)} {rng.choice(WORDS)} of the {rng.choice(WORDS)}." for _ in range(40))
    texts = ["# Title\n\n" + messages, "# Title\n\n" + article(rng, 400) + " Access denied was what the page said to all of us.", "# Title\n\n" + article(rng, 400)]
    c, p = tables(spark, [*texts, texts[1]])
    assert [r[0] for r in quality.residue_results(c, p).collect()] == [0]


def test_the_posterior_is_that_of_the_kind_reported(spark):
    """A list guessed prose shows how little the posterior has for a list."""
    row = {"in_list": 0.55, "common_words": 0.3, "in_sentences": 0.6, "mean_word_length": 5.0, "symbol_ratio": 0.02, "ended_lines": 0.9}
    plain = row | {"in_list": 0.0}
    names = ["words", "in_list", "in_table", "common_words", "in_sentences", "mean_word_length", "symbol_ratio", "ended_lines", "longest_token", "wide"]
    facts = spark.createDataFrame([(100, *(float(x.get(n, 0)) for n in names[1:])) for x in [plain] * 50 + [row]], names)
    kinds = {r["body_kind"]: r["posterior"] for r in quality.text_types(facts).collect()}
    assert set(kinds) == {"prose", "list"} and kinds["list"] < 0.5 < kinds["prose"]


# ---- 8 and 9 ------------------------------------------------------------------

TEXTS = ["", None, " ", "Hello  world's 12,5 €\r\n\t日本 é", "<|endoftext|>", "a" * 3000, " " * 500, "\x1c\x85\xa0x", "🙂" * 50, "mixed ASCII and ünïcode 123abc"]


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, *rows, (None, "x", None)], DOC)
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.token_ids(df).collect()}
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    encoder = tokens.Encoder.of(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    assert all(encoder.decode(got[i]) == (t or "") for i, t in enumerate(TEXTS))
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice((0, 1, 5, 100, 900, 1024, 2048, 2049, 5000, rng.randint(1, 2048)))) for i in range(600)]
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens int"), groups=3).collect()
    parts, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append((r["from_token"], r["n_tokens"]))
        bins[r["container_id"]].append((r["place"], r["n_tokens"]))
    for doc, n in sizes:
        own = sorted(parts.get(doc, []))
        assert sum(m for _, m in own) == n and [a for a, _ in own] == list(range(0, n, 2048))
        assert n > 2048 or len(own) <= 1
    for places in bins.values():
        at = 0
        for place, n in sorted(places):
            assert place == at
            at += n
        assert at <= 2048
    assert sum(n for _, n in sizes) / (2048 * len(bins)) > 0.97
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens int"), 1).count() == 0


def test_first_fit():
    items = sorted((random.Random(2).randint(1, 100) for _ in range(300)), reverse=True)
    free, plain = [], []
    for n in items:
        k = next((i for i, f in enumerate(free) if f >= n), None)
        if k is None:
            free.append(100)
            k = len(free) - 1
        plain.append((k, 100 - free[k]))
        free[k] -= n
    assert list(packing.first_fit_decreasing([(n, 0, 0, 0) for n in items], 100)) == plain


# ---- 10 -----------------------------------------------------------------------


def test_subjects(spark):
    rng = random.Random(6)
    topics = {t: [WORDS[20 * k + j] for j in range(12)] for k, t in enumerate(("law", "music", "sport"))}
    common = WORDS[80:120]

    def sentence(topic):
        return "The " + " ".join([rng.choice(topics[topic]), rng.choice(common), rng.choice(topics[topic]), rng.choice(common), rng.choice(common)]) + "."

    docs, truth = [], {}
    for i in range(300):
        own = rng.sample(sorted(topics), 2 if i % 4 == 0 else 1)
        docs.append((i, "# Head\n\n" + " ".join(sentence(own[k % len(own)]) for k in range(10)), "x"))
        truth[i] = set(own)
    docs += [(900, None, "x"), (901, "", "x"), (902, "```\ncode only\n```", "x")]
    labels = [(i, s) for i in range(0, 300, 4) for s in truth[i]] + [(i, s) for i in range(1, 300, 6) for s in truth[i]] + [(None, "law"), (1, None), (2, "unknown")]
    areas = [(t, "d") for t in topics] + [(None, None)]
    d, l, a = spark.createDataFrame([*docs, *docs], "doc_id long, text string, subject string"), spark.createDataFrame(labels * 2, "doc_id long, subject string"), spark.createDataFrame(areas, "subject string, description string")
    got = defaultdict(set)
    rows = subjects.document_subjects(d, l, a).collect()
    for r in rows:
        got[r["doc_id"]].add(r["subject"])
    assert len(rows) == sum(map(len, got.values())) and not got.keys() & {900, 901, 902}
    shares = subjects.composition(spark.createDataFrame(rows)).collect()
    assert abs(sum(r["share"] for r in shares) - 1) < 1e-9 and sum(r["documents"] for r in shares) == len(rows)
    unseen = [i for i in truth if i % 4 and (i - 1) % 6]
    assert sum(got[i] == truth[i] for i in unseen) >= 0.97 * len(unseen)
    assert subjects.document_subjects(d, l.limit(0), a).count() == subjects.document_subjects(d.limit(0), l, a).count() == 0


def test_pairs_across_two_blocks():
    """Only pairs of a fingerprint of one block and one of the other, and all of these."""
    rng = np.random.default_rng(2)
    high, low = (rng.integers(0, 1 << 63, 120, dtype=np.uint64) for _ in range(2))
    high[60:] = high[:60] ^ np.uint64(9)
    low[60:] = low[:60]
    side = np.array([0, 3] * 60)
    found = {tuple(sorted(p)) for a, b in N.GrayIndex(side, high, low).close_pairs(52, across=True) for p in zip(a.tolist(), b.tolist())}
    far = lambda i, j: bin(int(high[i] ^ high[j])).count("1") + bin(int(low[i] ^ low[j])).count("1")
    assert found == {(i, j) for i in range(120) for j in range(i + 1, 120) if side[i] != side[j] and far(i, j) <= 52}
    assert not list(N.GrayIndex(np.zeros(5, int), high[:5], low[:5]).close_pairs(128, across=True))


def test_crowded_leaves_grow_until_they_are_small(spark, monkeypatch):
    from leafmill.llm import messages

    monkeypatch.setattr(messages, "LEAF", 5)
    rows = [(i, f"the request number {w} failed at the {w} gate") for i, w in enumerate(WORDS[:20])] + [(100, "the request number none came to an end"), (101, "one alone")]
    got = {r["key"]: r["template"] for r in messages.mined(spark.createDataFrame(rows, "key long, sentence string")).collect()}
    assert set(got) == {k for k, _ in rows} and got[101] == "one alone"
    monkeypatch.setattr(messages, "LEAF", 2000)
    got = {r["key"]: r["template"] for r in messages.mined(spark.createDataFrame(rows, "key long, sentence string")).collect()}
    assert {got[i] for i in range(20)} == {"the request number <*> failed at the <*> gate"} and got[100] == rows[20][1]


def test_features_of_templates_are_learned():
    from leafmill.llm import messages

    messages_, passages = [3, 2, 0, 2, 0], [1, 2, 2, 3, 0]
    patterns = np.array([messages_, passages, [3, 2, 0, 2, 1], [0, 0, 2, 1, 0]])
    post = messages.learned(patterns, np.array([30.0, 4000.0, 10.0, 500.0]))
    assert post[0] > 0.9 and post[2] > 0.99 and max(post[1], post[3]) < 0.05


def test_slots_of_a_template_in_the_middle_of_nothing(spark):
    """A notice that names another thing on each page fits the template of those that return."""
    rng = random.Random(3)
    notice = lambda w: f"The shop of {w} opens its doors to members who come with a card."
    often = [notice(w) for w in WORDS[:4] for _ in range(12)]
    texts = [f"# {rng.choice(WORDS)} {rng.choice(WORDS)} {rng.choice(WORDS)}\n\n{n}" for n in often] + [f"# {rng.choice(WORDS)} {rng.choice(WORDS)}\n\n{notice(w)}" for w in WORDS[10:16]]
    texts += ["# A title\n\n" + article(rng, 60) for _ in range(20)]
    c, p = tables(spark, texts, hosts=30)
    assert sorted(r[0] for r in quality.residue_results(c, p).collect()) == list(range(len(often) + 6))
