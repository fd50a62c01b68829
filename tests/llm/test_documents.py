"""Packing, contamination and subjects on small texts."""

import random

import pytest

from strandweave.llm import contamination, packing, subjects


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def packed(spark, sizes, capacity, **how):
    items = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(sizes)], "id bigint, tokens int, lang string, tier string")
    specs = spark.createDataFrame([(1, capacity, None)], "spec int, capacity int, lang string")
    return packing.packed(items, specs, **how).collect()


@pytest.mark.parametrize("seed", range(3))
def test_packing_keeps_all_and_wastes_little(spark, seed):
    rng = random.Random(seed)
    sizes = [int(rng.paretovariate(0.9) * 20) % 3000 for _ in range(1500)]
    out = packed(spark, sizes, 512, bucket=400)
    held, places = {}, set()
    for r in out:
        held[r.container] = held.get(r.container, 0) + r.tokens
        assert (r.container, r.position) not in places
        places.add((r.container, r.position))
    assert max(held.values()) <= 512 and sum(held.values()) == sum(sizes)
    pieces = {}
    for r in out:
        pieces.setdefault(r.id, []).append((r.from_token, r.tokens))
    for i, s in enumerate(sizes):
        parts = sorted(pieces[i])
        assert len(parts) == max(1, -(-s // 512)) and sum(t for _, t in parts) == s and all(a == 512 * k for k, (a, _) in enumerate(parts))
    assert sum(sizes) / (512 * len(held)) > 0.97
    steps = {}
    for r in out:
        steps[r.step] = steps.get(r.step, 0) + r.tokens
    assert max(steps.values()) <= 16 * 512


def test_tiers_are_packed_in_windows_of_their_own():
    item = lambda i, n, t: (t, n, i, 0)
    three = [item(i, 30, 1) for i in range(6)]  # two windows of 50 a container, unless there is but one tier
    assert [len(h) for h in packing.pack_bucket([item(i, 30, 0) for i in range(6)], 100, 1)] == [3, 3]
    small = [item(10 + i, 12, 3) for i in range(6)]
    held = packing.pack_bucket(three + small, 100, 4)
    assert sorted(sorted(i[1] for i in h) for h in held) == [[12, 12, 12, 30, 30]] * 2 + [[30, 30]]
    assert sorted(i for h in held for i in h) == sorted(three + small)
    # without short items the emptiest container fills the others' gaps
    assert sorted(len(h) for h in packing.pack_bucket(three, 100, 4)) == [3, 3]


def test_steps_are_balanced_over_buckets(spark):
    rng = random.Random(11)
    out = packed(spark, [rng.randrange(1, 400) for _ in range(3000)], 512, bucket=300, step=8)
    containers, work, buckets = {}, {}, {}
    for r in out:
        containers.setdefault(r.step, set()).add(r.container)
        work[r.step] = work.get(r.step, 0) + r.tokens**2
        buckets.setdefault(r.step, set()).add(r.container >> 32)
    sizes = [len(c) for c in containers.values()]
    assert max(sizes) <= 8 and max(sizes) - min(sizes) <= 1 and len(set().union(*containers.values())) == sum(sizes)
    assert min(work.values()) > 0.8 * max(work.values()) and max(map(len, buckets.values())) > 1


def test_packing_edge_cases(spark):
    assert packed(spark, [], 100) == []
    assert [(r.id, r.piece, r.tokens) for r in sorted(packed(spark, [250], 100), key=lambda r: r.piece)] == [(0, 0, 100), (0, 1, 100), (0, 2, 50)]
    out = packed(spark, [0, 100, None], 100)
    assert sorted((r.id, r.tokens) for r in out) == [(0, 0), (1, 100)] and len({r.container for r in out}) == 1
    assert packed(spark, [5], 0) == []


def test_packing_by_language(spark):
    items = spark.createDataFrame([(1, 10, "en"), (2, 10, "de"), (3, 10, None)], "id bigint, tokens int, lang string")
    specs = spark.createDataFrame([(1, 100, None), (2, 100, "en")], "spec int, capacity int, lang string")
    assert sorted((r.spec, r.id) for r in packing.packed(items, specs).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    langs = spark.createDataFrame([("EN",), ("de-DE",), ("spa",), (None,)], "l string")
    assert [r[0] for r in langs.select(packing.language("l")).collect()] == ["en", "de", "es", None]


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "hello world <|endoftext|>", 1), (2, None, 1), (3, "", 1), (4, "é" * 3000, 1)], "doc_id bigint, text string, tokens int")
    got = dict(rows(packing.token_counts(docs, "doc_id", "text")))
    encode = packing.encoder(packing.TOKENIZER).encode_ordinary
    assert got == {1: len(encode("hello world <|endoftext|>")), 2: 0, 3: 0, 4: len(encode("é" * 3000))}


ITEM = "The amber lighthouse of Torvald keeps nineteen copper lanterns burning through every winter storm because sailors from Merrowick once promised its keeper a silver compass for each ship that found the harbour safely before dawn."
OTHER = "Seven quiet mathematicians in Belgrove argued about prime numbers until the kettle whistled and nobody remembered which conjecture they had wanted to refute with the chalk."
INSTRUCTION = "Read the passage below and answer the question that follows it."
ITEMS = [(1, f"{INSTRUCTION} {ITEM}"), (2, f"{INSTRUCTION} {OTHER}"), (3, ""), (4, None)]


def leaks(spark, texts):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    return [tuple(r[:2]) for r in sorted(contamination.leaked(docs, "doc_id", "text", items, "item_id", "text").collect())]


def test_leaks_in_many_layouts(spark):
    words = ITEM.split()
    edited = [w if i % 9 != 4 else "changed" for i, w in enumerate(words)]
    dropped = [w for i, w in enumerate(words) if i % 11 != 5]
    texts = [
        f"intro text. {ITEM} more text",
        "\n".join("+// " + " ".join(words[i : i + 5]) for i in range(0, len(words), 5)),
        ITEM.upper().replace(" ", " "),
        '{"prompt": "' + ITEM.replace(" ", "\\n") + '"}',
        " ".join(edited),
        " ".join(dropped),
        " ".join(words[: len(words) // 2 + 4]),
        "x " * 20_000 + ITEM,
        f"{ITEM} and then {OTHER}",
    ]
    assert leaks(spark, texts) == sorted([(i, 1) for i in range(9)] + [(8, 2)])


def test_what_is_no_leak(spark):
    words = ITEM.split()
    texts = [INSTRUCTION, " ".join(words[:9]), "", None, "nothing to see here", " ".join(reversed(words)), f"{INSTRUCTION} {' '.join(w for i, w in enumerate(words) if i % 3)}"[:120]]
    assert leaks(spark, texts) == []
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert contamination.leaked(empty, "doc_id", "text", items, "item_id", "text").collect() == []
    docs = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    assert contamination.leaked(docs, "doc_id", "text", items.limit(0), "item_id", "text").collect() == []
    assert len(contamination.leaked(docs.unionByName(docs), "doc_id", "text", items, "item_id", "text", block_chars=10).collect()) == 1


def brute(item, doc):
    best = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item):
        for j, b in enumerate(doc):
            best[i + 1][j + 1] = max(best[i][j] + (a == b), best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_matches_as_many_words_as_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        item = [b"%d" % rng.randrange(30) for _ in range(rng.randrange(1, 25))]
        doc = [w if rng.random() < 0.8 else b"x" for w in item if rng.random() < 0.9] + [b"y"] * rng.randrange(3)
        pairs = contamination.aligned(item, doc, 0, 30)
        assert all(item[i] == doc[j] for i, j in pairs) and pairs == sorted(pairs) and len(set(j for _, j in pairs)) == len(pairs)
        assert len(pairs) == brute(item, doc)


WORDS = {"food": "oven flour yeast garlic broth skillet pastry lentil".split(), "music": "violin chord tempo fugue choir melody octave cello".split()}


def corpus(n=400, seed=6):
    rng = random.Random(seed)
    docs, truth, labels = [], {}, []
    for i in range(n):
        subject = rng.choice(["food", "music", None])
        terms = rng.sample(WORDS[subject], 4) if subject else []
        lines = [f"+  int {t}Batch = {rng.randrange(99)}" for t in terms[1:]]
        passing = rng.choice(WORDS["food"]) if subject == "music" and i % 5 == 0 else ""
        text = f"commit abcdef0123\nAuthor: x <x@y>\n\n    fix the {terms[0] if terms else 'thing'} list {passing}\ndiff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1 +1 @@\n" + "\n".join(lines)
        docs.append((i, text, f"r{i % 4}"))
        truth[i] = {subject} - {None}
        if i % 3 == 0:
            labels.append((i, subject if i % 30 else "music"))
            if subject:
                labels.append((i, f" {subject.upper()} "))
    docs += [(n, None, None), (n + 1, "", "r1"), (n + 2, "Merge branch 'x' of oven flour yeast", None), (n + 3, "wip", "r0")]
    return docs, truth, labels


def test_subjects_of_documents_that_nobody_rated(spark):
    docs, truth, labels = corpus()
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id bigint, text string, repo string, id int, subject string, both int")
    about = spark.createDataFrame([("food", "cooking", "oven, flour"), ("music", "playing", "violin, chord")], "subject string, about string, sample_words string")
    rated = spark.createDataFrame(labels, "doc_id bigint, subject string")
    all_ = subjects.subject_posteriors(frame, rated, about).collect()
    found = {(r.doc_id, r.subject) for r in all_ if r.posterior >= 0.5}
    held_out = {i for i in truth if i % 3}
    assert {x for x in found if x[0] in held_out} == {(i, s) for i in held_out for s in truth[i]}
    assert found == {(i, s) for i, ss in truth.items() for s in ss}
    passing = [r for r in all_ if r.doc_id < len(truth) and r.subject not in truth[r.doc_id]]
    assert passing and all(r.posterior < 0.5 for r in passing)
    empty = subjects.subject_posteriors(frame.limit(0), rated.limit(0), about)
    assert empty.columns == ["doc_id", "subject", "terms", "posterior"] and empty.collect() == []


def test_the_posterior_weighs_functions_by_what_they_are_worth():
    import numpy as np

    # lexicon level 1 goes with neither address nor source; level 2 mostly does
    patterns = np.array([(1, 1, 0, 0), (1, 1, 1, 2), (2, 3, 1, 2), (2, 3, 0, 2), (2, 1, 0, 0), (3, 3, 1, 1), (3, 3, 0, 2)])
    n = np.array([300, 2, 150, 120, 20, 90, 200.0])
    start = np.clip((patterns / patterns.max(0)).mean(1), 0.05, 0.95)
    posterior = subjects.latent_model(patterns, n, start)
    assert posterior[0] < 0.1 and posterior[2] > 0.9 and posterior[3] > 0.9 and posterior[6] > 0.9


def test_sections_and_automatic_messages():
    text = "# HG changeset patch\n# User a\nFix überzogene Größe\n---\ndiff --git a/oven.c b/oven.c\n--- a/oven.c\n+++ b/oven.c\n@@ -1,2 +1,2 @@\n context\n-old\n+new\r\n"
    message, changed, paths = subjects.sections(text)
    assert "uberzogene Grosse" in message and "HG" not in message
    assert changed.split() == ["-old", "+new"] and "oven.c" in paths and "context" not in changed
    assert subjects.is_automatic("\n\n  Merge branch 'x'") and subjects.is_automatic("Subject: [PATCH] Bump a from 1 to 2") and not subjects.is_automatic("Merged thoughts")


def test_huge_texts_are_searched_whole():
    import pyarrow as pa

    texts = [t for _, t in ITEMS if t]
    index = contamination.Index([(i, t) for i, t in ITEMS if t], contamination.Rule(), contamination.shared_sentences(texts), contamination.frequent_words(texts, 0.05))
    docs = ["x" * n + " " + ITEM + " tail" * 500 for n in (5, 900, 1990, 2100, 3333)] + [OTHER]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs)], names=["id", "text"])
    for chunk in (64, 1000, 1 << 20):
        found = {(row, item) for row, item, *_ in contamination.searched(batch, index, chunk=chunk)}
        assert found == {(i, 1) for i in range(5)} | {(5, 2)}


def found_in(items, docs):
    import pyarrow as pa

    texts = [t for _, t in items]
    index = contamination.Index(items, contamination.Rule(), contamination.shared_sentences(texts), contamination.frequent_words(texts, 0.05))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs)], names=["id", "text"])
    return {(row, item) for row, item, *_ in contamination.searched(batch, index)}


def test_a_third_with_long_words_edited_is_found():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for short, edits in ((5, {2, 7, 12, 17}), (5, {3, 6, 9, 12, 15}), (2, {3, 6, 9, 12, 15})):
        words = [word(12 if i % 20 in edits else short) for i in range(60)]
        item = " ".join(words)
        docs = [" ".join("new" if i % 20 in edits else words[i] for i in range(at, at + 20)) for at in (0, 20, 40)]
        docs.append("x " * 400 + docs[0] + " y" * 400)
        assert found_in([(1, item), (2, OTHER)], docs) == {(i, 1) for i in range(4)}


def test_bound_by_grams_is_one():
    rng = random.Random(9)
    rule = contamination.Rule()
    for _ in range(30):
        words = [b"%0*d" % (rng.randrange(1, 12), rng.randrange(10)) + b"%d" % i for i in range(rng.randrange(12, 50))]
        item = [bytes(w) for w in words]
        doc = [b"other" if rng.random() < 0.2 else w for w in item]
        pairs = contamination.aligned(item, doc, 0, 24)
        kept = contamination.stretches(pairs, rule)
        if sum(b - a + 1 for a, b in kept) < len(item) * rule.share:
            continue
        shared = set(contamination.grams(contamination.LETTER[list(b"".join(item))]).tolist()) & set(contamination.grams(contamination.LETTER[list(b"".join(doc))]).tolist())
        assert len(shared) >= contamination.least_grams([len(w) for w in item], rule)


def test_distinctive_words_count_for_the_item_not_each_stretch():
    rng = random.Random(10)
    common = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(60)]

    def mixed(own):
        words = rng.sample(common, 60)
        for at, w in own.items():
            words[at] = w
        return words

    once = mixed({4: "torvald", 15: "lantern", 34: "merrowick", 50: "harbour"})
    twice = mixed({4: "silverwing", 6: "copperhead", 34: "silverwing", 36: "copperhead", 50: "silverwing", 55: "copperhead"})
    items = [(1, " ".join(once)), (2, " ".join(twice)), *((k, " ".join(mixed({}))) for k in range(3, 12))]
    docs = [" ".join(["start", *words[:10], *["between"] * 6, *words[30:40], "end"]) for words in (once, twice)]
    docs.append(" ".join(once[:10]))
    assert found_in(items, docs) == {(0, 1), (1, 2)}


def passages(share, items, docs):
    import pyarrow as pa

    rule, texts = contamination.Rule(share=share), [t for _, t in items]
    index = contamination.Index(items, rule, contamination.shared_sentences(texts), contamination.frequent_words(texts, rule.rare))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs)], names=["id", "text"])
    return {(row, item): got for row, item, got, *_ in contamination.searched(batch, index)}


def made_words(seed, n, low=3, high=9):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(low, high))) for _ in range(n)]


def test_stretches_of_a_huge_text_are_added_up():
    words = made_words(21, 60)
    filler = "tail of other words " * 1_000_000  # 20 MB
    docs = [" ".join(words[:14]) + f" {filler} " + " ".join(words[30:44]), " ".join(words[:14]) + f" {filler}"]
    assert passages(1 / 3, [(1, " ".join(words)), (2, OTHER)], docs) == {(0, 1): 28}


def test_small_passages_are_reported():
    words = made_words(22, 60)
    item, docs = [(1, " ".join(words)), (2, OTHER)], ["so " + " ".join(words[5 : 5 + n]) + " there" for n in (15, 18, 9, 6)]
    assert passages(1 / 3, item, docs) == {}
    found = passages(0.0, item, docs)
    assert found[0, 1] == 15 and found[1, 1] == 18 and (3, 1) not in found


def test_items_with_a_quarter_of_the_words_replaced_are_found():
    items = [(k, " ".join(made_words(100 + k, 60))) for k in range(100)]
    for every, edits in ((4, 15), (5, 12)):
        docs = [" ".join("new" if i % every == every - 1 else w for i, w in enumerate(t.split())) for _, t in items]
        assert edits == docs[0].split().count("new")
        assert {(k, k) for k, _ in items} <= found_in(items, docs)


def test_several_blocks_are_searched_in_one_pass(spark):
    items = spark.createDataFrame([(k, " ".join(made_words(200 + k, 40))) for k in range(12)], "item_id bigint, text string")
    docs = items.withColumnRenamed("item_id", "doc_id").repartition(3)
    for blocks in (1, 4, 50):
        found = contamination.leaked(docs, "doc_id", "text", items, "item_id", "text", block_chars=600, blocks=blocks)
        assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(k, k) for k in range(12)]
    with pytest.raises(ValueError, match="more than 100"):
        contamination.leaked(docs, "doc_id", "text", items, "item_id", "text", most_chars=100)
