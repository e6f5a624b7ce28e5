import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zlib

import corpus_pipeline
from tests.compare import duck, same
from tests.llm.conftest import TAKEN, frame
from tidemark.llm import decontamination, line_dedup, ngram_join, quality, toxicity
from tidemark.llm.components import components

SMALL, FOLDER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for a, b in {(a, b) for held in holders.values() for a in held for b in held if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least[r] is None else least[r] if i is None else min(least[r], i)
    return Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def joined(df):
    return Counter(tuple(r) for r in ngram_join.ngram_join(df).collect())


def test_ngram_join(spark, odd, odd_rows, nothing):
    assert joined(odd) == brute_components(odd_rows)
    assert ngram_join.ngram_join(nothing).count() == 0


def test_ngram_join_on_families(spark, monkeypatch):
    """Families of copies with more and more changes, a passage that many share, chains of links."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(4000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, rows = text(60), []
    for size in (20, 60, 90, 140, 180, 300, 420):
        for _ in range(3):
            base = text(size)
            for _ in range(14):
                own = list(base)
                for _ in range(rng.randint(0, max(1, size // 18))):
                    own[rng.randrange(size)] = rng.choice(words)
                rows.append(own)
    rows += [[*text(rng.randint(0, 60)), *passage, *text(rng.randint(0, 30))] for _ in range(90)]
    chain = text(200)
    for _ in range(30):
        chain = list(chain)
        chain[rng.randrange(200)] = rng.choice(words)
        rows.append(chain)
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want = brute_components(rows)
    for rare, rounds, combine, before in ((32, 2, 8, 4), (3, 0, 24, 4), (1, 1, 1000, 2), (1, 0, 1000, 4), (2, 0, 0, 1)):
        monkeypatch.setattr(ngram_join, "RARE", rare)
        monkeypatch.setattr(ngram_join, "STAR_ROUNDS", rounds)
        monkeypatch.setattr(ngram_join, "COMBINE", combine)
        monkeypatch.setattr(ngram_join, "BEFORE", before)
        assert joined(frame(spark, rows)) == want


def test_ngram_oracle(spark):
    same(ngram_join.op1_ngram_join(spark, SMALL), ngram_join.ORACLE, SMALL)


def test_common_at_most():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, y = (np.sort(rng.integers(0, 40, rng.integers(0, 60)).astype(np.uint16)) for _ in range(2))
        assert ngram_join.common_at_most(x, y) == sum((Counter(x.tolist()) & Counter(y.tolist())).values())


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (3, 200, 3000):
        x, y = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        y[: n // 2] = x[: n // 2]
        bits = [int.from_bytes(ngram_join.parity_bits(np.unique(s)), "big") for s in (x, y)]
        assert 0 < (bits[0] ^ bits[1]).bit_count() <= len(np.setxor1d(x, y))


def test_ngram_join_of_one_hot_row(spark):
    """A row repeated very often, a boilerplate page with a changing word, and a page that only looks like it."""
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words))] * 400 + [(10 + k, " ".join([*words[:30], f"own{k}", *words[31:]])) for k in range(120)]
    rows += [(1000 + k, " ".join([*words[:40], *[f"x{k}{j}" for j in range(20)]])) for k in range(120)]
    assert joined(frame(spark, rows)) == brute_components(rows)


def test_needed_is_a_lower_bound():
    for n in (1, 2, 5, 20, 96, 128, 129, 150, 200, 300, 550, 900):
        e = ngram_join.extended_length
        pairs = range(-(-75 * n // 100), 100 * n // 75 + 1)
        want = min(-(-75 * (n + m) // 175) - (s - e(s)) for m in pairs for s in (n, m))
        assert ngram_join.needed(n) == max(1, want)


def test_one_of_each(spark, odd, odd_rows):
    kept = [(r.doc_id, r.text) for r in ngram_join.one_of_each(odd).collect()]
    found = {(i, n): c for i, n, c in brute_components(odd_rows)}
    texts = {(i, t) for i, t in odd_rows}
    assert set(kept) <= texts and len(set(kept)) >= 64
    assert (5, dict((i, t) for i, t in odd_rows)[5]) in kept and not {6, 7, 8, None} & {i for i, t in kept if t and len(t) > 400 and i != 13 and i != 14 and i != 16 and i is not None and i < 10} - {5}
    assert found


def test_components(spark):
    rng = random.Random(1)
    for links in ([], [(1, 2)], [(k, k + 1) for k in range(60)], [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]):
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in links:
            if a != b:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {x: find(x) for x in list(parent)}


def brute_lines(rows):
    order = sorted({i for i, _ in rows if i is not None}) + [None]
    firsts, docs = {}, {}
    for i, t in rows:
        docs.setdefault(i, []).append(t or "")
    for i in order:
        for t in docs.get(i, []):
            for n, raw in enumerate(t.split("\n")):
                if line := raw.strip(" "):
                    firsts.setdefault(line, (order.index(i), n))

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]

    late = {a for a in firsts for b in firsts if firsts[b] < firsts[a] and len(a) >= 24 and len(b) >= 24 and near(a, b)}
    out = []
    for i, t in rows:
        seen, kept, exact, close = set(), [], 0, 0
        for raw in (t or "").split("\n"):
            line = raw.strip(" ")
            if line and (line in seen or firsts[line][0] < order.index(i)):
                exact += 1
            elif line in late:
                close += 1
            else:
                kept.append(raw)
            seen.add(line)
        out.append((i, "\n".join(kept) if exact + close else t, exact, close))
    return Counter(out)


def lines_of(df):
    return Counter((r.doc_id, r.ld_text, r.ld_exact, r.ld_near) for r in line_dedup.dedup_lines(df).collect())


def test_line_dedup(spark, odd, odd_rows, nothing):
    assert lines_of(odd) == brute_lines(odd_rows)
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_dedup_finds_every_edit(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abc de") for _ in range(rng.randint(15, 60))).strip() or "x" for _ in range(30)]
    rows = []
    for i in range(200):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(line))
                line = rng.choice([line[:p] + rng.choice("abcz") + line[p + 1 :], line[:p] + line[p + 1 :] or "y", line[:p] + rng.choice("abcz") + line[p:]])
            lines.append(rng.choice(["", "  "]) + line)
        rows.append((i, "\n".join(lines) if rng.random() > 0.03 else None))
    want = brute_lines(rows)
    assert sum(k[3] for k in want) > 50 and lines_of(frame(spark, rows)) == want


def test_line_oracle(spark):
    got = {tuple(r) for r in line_dedup.op5_line_dedup(spark, SMALL).select("doc_id", "n_lines", "n_exact", "n_near", "text_sha256").collect()}
    assert got == set(duck(SMALL).sql(f"select doc_id, n_lines, n_exact, n_near, text_sha256 from ({line_dedup.ORACLE})").fetchall())


def judged(spark, rows, items, **options):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in decontamination.contamination(frame(spark, rows), benchmark, **options).collect()}


QUESTION = "A train leaves Paris at 9 and travels 120 km in 2 hours; how far does Paris lie from the town if the train drives on for 3 hours more?"


def test_decontamination(spark, odd, nothing):
    other = QUESTION.replace("Paris", "Madrid").replace("120", "350").replace("km", "miles")
    mixed = QUESTION.replace("leaves Paris", "leaves Madrid")  # one name stands for two
    rows = [(1, f"before. {QUESTION} after"), (2, f"Text. {other} More text."), (3, mixed), (4, "nothing of the kind at all, only words in a row that say little"), (5, None), (6, "")]
    found = judged(spark, rows, [(7, QUESTION), (8, "too short"), (9, None), (None, QUESTION)])
    assert {i for i, r in found.items() if r.dc_items} == {1, 2}
    assert found[1].dc_item == 7 and not found[1].dc_changed and found[1].dc_coverage > 0.9
    assert found[2].dc_changed and found[2].dc_coverage > 0.9
    assert found[5].text is None and found[3].dc_coverage < 0.9
    assert decontamination.contamination(nothing, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontamination.contamination(odd, spark.createDataFrame([], "item_id long, text string")).count() == odd.count()


def test_decontamination_finds_copies_of_slots_and_of_other_case(spark):
    slots = "mix 3 kg 4 g 5 lb 6 oz 7 kg 8 g 9 lb 10 oz"
    lettered = "A long rope hangs from the high tower and a short one lies in a box while Anna ties a knot"
    rows = [(1, f"Then {slots} at once"), (2, f"so {lettered.lower()} it is"), (3, "then mix 13 kg 14 g 15 lb 16 oz 17 kg 18 g 19 lb 20 oz"), (4, f"Then {slots.upper()} at once")]
    found = judged(spark, rows, [(1, slots), (2, lettered)])
    assert {i: list(r.dc_items) for i, r in found.items() if r.dc_items} == {1: [1], 2: [2], 4: [1]}
    assert found[1].dc_coverage == 1 and not found[1].dc_changed


def test_benchmark_blocks_give_the_same(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted((r.doc_id, tuple(r.dc_items), r.dc_item, r.dc_coverage) for r in df.collect())
    whole = key(decontamination.contamination(docs, benchmark))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)
    assert key(decontamination.contamination(docs, benchmark)) == whole


def test_decontamination_finds_the_planted_passages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    plain = lambda t: " ".join("".join(c for c in (t or "").lower() if c.isalnum() or c.isspace()).split())
    texts = {d.doc_id: plain(d.text) for d in docs}
    want = {i for i, t in texts.items() if any(plain(x.text) in t for x in items)}
    got = {r.doc_id for r in decontamination.op9_decontamination(spark, FOLDER).collect() if r.contaminated}
    assert want and got == want


def auc(scored, labels, column):
    y = {r.doc_id: r[column] for r in labels.collect()}
    rows = [(r.score, y[r.doc_id]) for r in scored.collect() if r.held_out and r.doc_id in y]
    good, bad = [s for s, v in rows if v], [s for s, v in rows if not v]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


@pytest.mark.parametrize("name, query, column, parts, part, least", [("quality", quality.op10_quality, "quality", 5, 0, 0.97), ("toxic", toxicity.op2_toxicity, "toxic", 4, 2, 0.92)])
def test_classifiers_on_held_out_labels(spark, name, query, column, parts, part, least):
    folder = "/root/testdata/sf0.1"
    scored = query(spark, folder).cache()
    assert auc(scored, spark.read.parquet(f"{folder}/labels.parquet"), column) >= least
    for r in scored.limit(500).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers_on_odd_rows(spark, odd, odd_rows, nothing, score):
    labels = spark.createDataFrame([(i, i % 2, int(i == 15)) for i in range(17)] + [(None, 1, 1), (3, None, None), (100, 1, 0)], "doc_id long, quality int, toxic int")
    assert score(odd, labels).count() == len(odd_rows)
    assert score(nothing, labels).count() == 0
    assert score(odd, labels.limit(0)).where("score is null").count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    for score, column, parts, part in ((quality.score_quality, "quality", 5, 0), (toxicity.score_toxicity, "toxic", 4, 2)):
        turned = labels.withColumn(column, labels[column] + (1 - 2 * labels[column]) * quality.held_out("doc_id", parts, part).cast("int"))
        assert sorted(map(tuple, score(docs, labels).collect())) == sorted(map(tuple, score(docs, turned).collect()))


def test_attention_gradients():
    rng = np.random.default_rng(0)
    rows, counts, y = rng.normal(size=(12, quality.N_FEATURES)), np.array([3, 1, 5, 3]), np.array([1.0, 0, 1, 0])
    model = quality.AttentionModel(rows.mean(0), rows.std(0) + 1e-3)
    loss = lambda: -np.mean(y * np.log(p := model.forward(rows, counts)["chance"]) + (1 - y) * np.log(1 - p))
    for name, slope in model.gradients(rows, counts, y).items():
        w = model.weights[name]
        at = tuple(rng.integers(0, s) for s in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert slope[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_grammar_patterns():
    lexicon = toxicity.Lexicon({"fool": 2.0}, {"dolt": 3.0})
    row = lambda t: toxicity.match_features(pa.array([t]), lexicon)[0, :8]
    names = {"a fool here": 0, "you are a fool": 1, "he is not a fool": 2, "they said fool": 3, "we kill time": 4, "I will kill": 4, "you kill": 5, "never kill": 6, "she wrote kill": 7, "not that. fool": 0, "DOLTISH!": 0}
    for text, pattern in names.items():
        found = row(text)
        assert found[pattern] > 0 and (found > 0).sum() == 1, text
    assert not row("nothing to see").any()


def brute_patterns(text, lexicon):
    """Weights by pattern, each match looked at by itself: what stands before and after it in its clause and sentence."""
    flat = [x for raw in text.split(" ") for x in toxicity.symbols_of(raw, lexicon)]
    out = [0.0] * 8
    for k, (symbol, weight) in enumerate(flat):
        if symbol not in (toxicity.INSULT, toxicity.THREAT):
            continue

        def near(wanted, step, most, k=k):
            for n in range(1, most + 1):
                if not 0 <= k + step * n < len(flat) or flat[k + step * n][0] in (toxicity.STOP, toxicity.BREAK):
                    return False
                if flat[k + step * n][0] == wanted:
                    return True
            return False

        stop = max([n for n in range(k) if flat[n][0] == toxicity.STOP], default=-1)
        reported = any(s == toxicity.REPORT for s, _ in flat[stop + 1 : k])
        own = 3 if reported else 2 if near(toxicity.NEGATION, -1, 3) else 1 if near(toxicity.TARGET, -1, 4) or near(toxicity.TARGET, 1, 4) else 0
        out[own + (4 if symbol == toxicity.THREAT else 0)] += weight
    return out


def test_grammar_against_brute_force():
    rng = random.Random(2)
    lexicon = toxicity.Lexicon({"fool": 2.0, "twit": 1.5}, {"dolt": 3.0})
    words = "fool twit dolts kill you they not never said wrote a the tree stone Fool, you; said. kill! not? fool\nyou one two three four".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    got = np.expm1(toxicity.match_features(pa.array(texts), lexicon)[:, :8])
    assert np.allclose(got, [brute_patterns(t, lexicon) for t in texts])
    assert np.count_nonzero(got.sum(axis=0)) == 8


def test_negated_and_reported_insults_score_less(spark):
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice("the tree river stone house walks over green hill bread you are a what came by he is".split()) for _ in range(rng.randint(3, 30)))
    rows = [(i, f"{plain()}. {rng.choice(['you are a', 'what a', 'the'])} zorgle {plain()}" if i % 3 == 0 else plain()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    cases = ["he is a zorgle", "zorgle you are", "he is not a zorgle", "they said a zorgle came", "a bread came by"]
    found = {r.doc_id: r.score for r in toxicity.score_toxicity(frame(spark, rows + [(1000 + k, t) for k, t in enumerate(cases)]), labels).collect()}
    said, aimed, negated, reported, none = (found[1000 + k] for k in range(5))
    assert min(said, aimed) > 0.5 > 0.3 > max(negated, reported) and none < 0.3
    lexicon = toxicity.Lexicon({"fool": 2.0}, {})
    rows = toxicity.match_features(pa.array(["fool you are", "he is not a fool", "they said a fool"]), lexicon)
    assert rows[0, 1] > 0 and not rows[1:, 8:13].any()


def test_columns_with_the_names_of_ours_stay(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(17)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "a row without an id, with words enough to count"), (2, "one two")], "item_id long, text string")
    own = {name: f"own {name}" for name in TAKEN}
    for docs in (odd, nothing):
        kept = [quality.keep_good(docs, labels), line_dedup.without_repeated_lines(docs), ngram_join.one_of_each(docs), decontamination.without_contaminated(docs, benchmark)]
        for out in kept:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            rows = out.collect()
            assert all(r[name] == value for r in rows for name, value in own.items())
            assert bool(rows) == (docs is odd)
        results = [({"q_score"}, quality.quality_scores(docs, None)), ({"ld_text", "ld_exact", "ld_near"}, line_dedup.dedup_lines(docs)), ({"dc_items", "dc_item", "dc_coverage", "dc_changed"}, decontamination.contamination(docs, benchmark))]
        for names, out in results:
            assert set(out.columns) == set(docs.columns) | names
            rows = out.collect()
            assert len(rows) == (len(odd_rows) if docs is odd else 0)
            assert all(r[name] == value for r in rows for name, value in own.items() if name not in names)


def test_slots_of_spelled_numbers_and_long_or_opening_names(spark):
    item = "Anna Karen Smith buys twelve red apples at the market and gives half of them to her old neighbour. Bob eats the twelve apples that lie on the table and then walks home"
    texts = {
        1: item.replace("Anna Karen Smith", "Otto Braun").replace("twelve", "forty-two").replace("Bob", "Maria"),
        2: item.replace("Anna Karen Smith", "Otto").replace("twelve", "37"),
        3: item.lower(), 4: item.upper(),
        5: item.replace("twelve red", "nine hundred red"),  # the other twelve stays
        6: "Clara walks home and eats at the market with her old neighbour and twelve red hens that lie on the table",
    }
    found = judged(spark, list(texts.items()), [(1, item)])
    assert {i for i, r in found.items() if r.dc_items} == {1, 2, 3, 4}
    assert found[1].dc_changed and found[1].dc_coverage == 1 and not found[3].dc_changed


def test_recall_of_reparameterised_items(spark):
    """Every item with numbers or names, with other ones put in consistently, in a random text; texts without items stay clean."""
    rng = random.Random(9)
    names, places = ["Anna", "Otto Braun", "Maria", "Chen Wei", "Priya"], ["Paris", "New Delhi", "Oslo", "Lima"]
    templates = [
        "{n} has {a} marbles and gives {b} of them to a friend who lives in {p} near the old bridge; how many marbles does {n} keep?",
        "A train leaves {p} at {a} and travels {b} km in the morning before it stops; how far from {p} is it when it stops at noon?",
        "When {n} was {a} years old the family moved to {p} and bought a house with {b} rooms; in which room did {n} sleep that year?",
        "If a shop in {p} sells {a} loaves each day and bakes {b} more on Sundays, how many loaves does {n} have to bake in a week?",
    ]
    spelled = ["seven", "twelve", "twenty-one", "ninety"]
    make = lambda t: t.format(n=rng.choice(names), p=rng.choice(places), a=(x := rng.sample(range(3, 90), 2))[0], b=rng.choice([x[1], rng.choice(spelled)]))
    items = [(k, make(templates[k % 4])) for k in range(8)]
    words = [f"w{k}" for k in range(300)]
    filler = lambda: " ".join(rng.choice(words) for _ in range(40))
    rows = [(k, f"{filler()}. {make(templates[k % 4])} {filler()}") for k in range(120)] + [(1000 + k, filler()) for k in range(80)]
    found = judged(spark, rows, items)
    caught = sum(bool(found[k].dc_items) for k in range(120))
    assert caught >= 0.9 * 120 and not any(found[1000 + k].dc_items for k in range(80))
    assert all(i % 4 == k % 4 for k in range(120) for i in found[k].dc_items)


def test_short_items_match_word_for_word(spark):
    found = judged(spark, [(1, "he said one two and went"), (2, "one, then two"), (3, "In 1999 it fell"), (4, "Zug")], [(1, "One two"), (2, "1998"), (3, "zug"), (4, " ?! ")])
    assert {i: list(r.dc_items) for i, r in found.items() if r.dc_items} == {1: [1], 4: [3]}


def test_all_passages_of_labelled_texts_are_read(spark):
    """A label that only shows after the former 64 passages, and a bound on passages that leaves rows out."""
    rng = random.Random(8)
    words = "the tree river stone house walks over green hill bread".split()
    long = lambda tail: " ".join([*(rng.choice(words) for _ in range(6000)), *tail])
    rows = [(i, long(["||||", "####"] * 300 if i % 2 else ["hill"] * 600)) for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    scored = {r.doc_id: r for r in quality.score_quality(frame(spark, rows), labels).collect()}
    assert all((r.score >= 0.5) == (i % 2 == 0) for i, r in scored.items() if r.held_out)


def test_long_paths_of_links(spark):
    path = [(k, k + 1) for k in range(1500)]
    assert {r.comp for r in components(spark.createDataFrame(path, "a long, b long")).collect()} == {0}


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_and_empty_tables(spark, odd, nothing, number):
    """Each stage by itself; ``labels`` and ``benchmark`` are those of the small tables."""
    stage = corpus_pipeline.STAGES[number][1]
    assert stage(spark, nothing, SMALL).count() == 0
    out = stage(spark, odd, SMALL)
    assert out.count() > 0 and (number == 4 or out.columns == odd.columns)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in quality.op10_quality(spark, SMALL).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id]]
    lines = {(i, t): (n, m) for i, t, n, m in brute_lines(rows)}
    rows = [(i, t) for (i, t), (n, m) in lines.items() if not (n + m and not (t or "").strip())]
    comp = {(i, n): c for i, n, c in brute_components(rows)}
    least = {i for (i, _), c in comp.items() if i == c}
    rows = [(i, t) for i, t in rows if i in least]
    dirty = {i for i, r in judged(spark, rows, [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]).items() if r.dc_items}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in rows if i not in dirty}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_join", "decontamination", "packing"]
    current = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, SMALL)
        assert current.columns == docs.columns and current.count() > 0
