"""Packing, leakage and truncation on small fixtures and against brute force."""

import collections
import random

from pyspark.sql import functions as F

from papyrine.llm import leakage as L
from papyrine.llm import packing as P
from papyrine.llm import truncation as T
from tests.conftest import rows

SIZES = "doc_id long, source string, n_tokens long"


def pack(spark, data, **how):
    return P.packed(spark.createDataFrame(data, SIZES), **how).collect()


def test_packing_keeps_every_token_and_capacity(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("aaab") + str(i % 3), rng.choice([0, 3, 40, 2048, 5000, *(rng.randrange(1, 700) for _ in range(9))])) for i in range(3000)]
    got = pack(spark, data, shard_texts=1000)
    per = collections.Counter()
    windows = collections.defaultdict(list)
    for r in got:
        per[r.doc_id] += r.n_tokens
        if r.seq_id is not None:
            windows[r.seq_id].append((r.place, r.start_token, r.n_tokens, r.doc_id, r.piece))
    assert per == {i: n for i, _, n in data}
    for w in windows.values():
        w.sort()
        assert sum(x[2] for x in w) <= 2048 and [x[0] for x in w] == list(range(len(w)))
        assert all(a[1] + a[2] == b[1] for a, b in zip(w, w[1:], strict=False))
    split = {r.doc_id for r in got if r.piece > 0}
    assert split == {i for i, _, n in data if n > 2048}
    used = sum(n for _, _, n in data)
    assert used / (len(windows) * 2048) > 0.97


def test_mixture_holds_in_every_stretch_of_windows():
    rng = random.Random(1)
    sizes = [rng.randrange(20, 600) for _ in range(4000)]
    sources = [rng.choice("xxxyyz") for _ in sizes]
    total = collections.Counter()
    for n, s in zip(sizes, sources, strict=True):
        total[s] += n
    shares = {s: t / sum(total.values()) for s, t in total.items()}
    windows = P.fill(sizes, sources, shares, {}, 2048)
    for at in range(0, len(windows) - 60, 50):
        got = collections.Counter()
        for w in windows[at : at + 50]:
            for i in w:
                got[sources[i]] += sizes[i]
        assert all(abs(got[s] / sum(got.values()) - shares[s]) < 0.03 for s in shares)


def test_a_stated_mixture_holds_until_a_source_runs_dry(spark):
    rng = random.Random(4)
    data = [(i, rng.choice("aaaaabbbc"), rng.randrange(20, 400)) for i in range(6000)]
    target = {"a": 0.4, "b": 0.4, "c": 0.2}
    for mixture, want in ((target, target), (P.EVEN, dict.fromkeys("abc", 1 / 3))):
        df = P.packed(spark.createDataFrame(data, SIZES), mixture=mixture, shard_texts=2500)
        got = P.mixture_report(df, mixture, run=16).collect()
        assert sum(r.n_tokens for r in got) == sum(n for _, _, n in data) and {r.source: r.target for r in got} == {k: round(v, 6) for k, v in want.items()}
        low = {(r.shard, r.run): min(x.left for x in got if (x.shard, x.run) == (r.shard, r.run)) for r in got}
        full = [r for r in got if low[r.shard, r.run] > 0]
        off = sorted(abs(r.deviation) for r in full)
        assert len(off) > 20 and off[len(off) * 3 // 4] < 0.02  # the first runs of a shard pay back what the one before was given less of
    assert P.mixture_report(df.limit(0)).count() == 0


def test_deficits_are_carried_between_shards():
    first = P.fill([10, 10, 10], ["a", "b", "b"], {"a": 0.5, "b": 0.5}, {"b": 15.0, "a": -15.0}, 10)
    assert first == [[2], [1], [0]] or first == [[1], [2], [0]]  # b is behind and comes first


def test_packing_odd_rows(spark):
    assert pack(spark, []) == []
    got = pack(spark, [(1, "s", 0), (2, "s", 2048), (3, "s", 4096), (4, "s", 1)])
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in got) == [(1, 0, 0), (2, 0, 2048), (3, 0, 2048), (3, 1, 2048), (4, 0, 1)]
    docs = spark.createDataFrame([(1, "Hello world", None), (1, "Hello world", None), (2, None, "s"), (3, "", "s"), (4, "x " * 30_000, "s"), (None, "no id", "s")], "doc_id long, text string, source string").withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit(2))
    sizes = {r.doc_id: r.n_tokens for r in P.token_sizes(docs).collect()}
    assert sizes[1] == 2 and sizes[2] == sizes[3] == 0 and sizes[4] > 29_000
    assert pack(spark, [(1, "a", 5), (2, "b", 5)], mixture={"a": 0.9, "b": 0.1})[0].n_tokens == 5


ITEM = "A 56-year-old pale puppeteer from the walled fair rang the ward with tender hearing loss the week of the flood and denied an unlabeled vial while KJN2 rose by 16.3 percent within 8 weeks so compute the odds of a second fall"


def leaks(spark, texts, items=((1, ITEM),), **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("part", F.lit("clash"))
    got = L.leaks(docs, spark.createDataFrame(list(items), "item_id long, text string").withColumn("kind", F.lit(0)), **how)
    return {(r.doc_id, r.item_id): r for r in got.collect()}


def test_leaks_in_any_dress(spark):
    w = ITEM.split()
    half = " ".join(w[5:28])
    noisy = "Before. " + ITEM.upper().replace("WALLED", "WAL-\nLED").replace("THE WARD", "THE&nbsp;<b>WARD</b>") + " After."
    changed = " ".join("other" if i % 9 == 4 else x for i, x in enumerate(w))
    too_many = " ".join("other" if i % 4 == 1 else x for i, x in enumerate(w))
    short = "He wrote " + " ".join(w[:10]) + " in his notes."
    got = leaks(spark, ["x " + half + " y", noisy, changed, too_many, short, None, "", ITEM * 2, "filler words here " * 3000 + ITEM])
    assert set(got) == {(0, 1), (1, 1), (2, 1), (7, 1), (8, 1)}
    assert got[1, 1].kind == "exact" and got[2, 1].kind == "exchanged" and got[8, 1].part == 1


def test_capitals_inside_a_long_text_are_no_names(spark):
    filler = "the quiet clerk counted boxes by the river until noon and went home again " * 40
    capitals = filler + ITEM.upper() + " " + filler
    named = ITEM.replace("pale puppeteer", "PALE PUPPETEER").replace("tender hearing loss", "TENDER HEARING LOSS")
    got = leaks(spark, [capitals, filler + ITEM.lower()], ((1, ITEM), (2, named)))
    assert set(got) == {(0, 1), (0, 2), (1, 1), (1, 2)} and all(r.kind == "exact" and r.part == 1 for r in got.values())


def test_reparameterised(spark):
    text = ITEM.replace("56-year-old", "71-year-old").replace("KJN2", "QRS7").replace("16.3", "22.9")
    r = leaks(spark, [text])[0, 1]
    assert r.kind == "reparameterised" and r.consistent and r.slots_changed >= 3


def test_reparameterised_beyond_one_word_in_eight(spark):
    item = "A 56-year-old woman takes 40 mg of drug A12 and 16 mg of drug B7 for 12 weeks. How many days pass until 90 percent of 40 mg of drug A12 has left her body after 3 doses of B7?"
    text = item.replace("56", "61").replace("40", "75").replace("A12", "X9").replace("16", "18").replace("B7", "Q55").replace("12 weeks", "30 weeks").replace("90", "80").replace("3 doses", "5 doses")
    mixed = text.replace("75 mg of drug X9 has", "99 mg of drug X9 has")  # 40 stands for two values
    got = leaks(spark, ["Before. " + text + " After.", mixed], ((1, item),))
    r = got[0, 1]
    assert set(got) == {(0, 1)} and r.by == "template" and r.kind == "reparameterised" and r.consistent and r.exchanged > r.matched_words / 8


def test_leak_windows_by_shuffle_and_odd_items(spark, monkeypatch):
    items = [(i, f"{ITEM} item {i}") for i in range(5)] + [(9, None), (10, "too few words"), (11, "")]
    whole = leaks(spark, [ITEM + " item 3"], items)
    monkeypatch.setattr(L, "BROADCAST_WINDOWS", 3)
    assert set(whole) == set(leaks(spark, [ITEM + " item 3"], items)) == {(0, i) for i in range(5)}
    assert leaks(spark, ["text"], ((1, None),)) == {} and leaks(spark, []) == {}
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.leaks(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


def corpus():
    """Template sentences with values, closing lines without a stop, and cuts."""
    rng = random.Random(2)
    frames = ["Serious adverse events occurred in {} participants.", "Tubes were spun at {} g for nine minutes and kept on ice.", "Costs per patient were estimated from tariffs of {}.", "The steering group met every {} months to review safety data.", "Participants kept a diary of fatigue, hoarseness and sleep over {} weeks."]
    closings = ["Funding: none declared", "n = {}", "Registered as XT-{}", "- lipid oxidation", "and so on ...", "(continued in Part {})", "Unit 4, Bldg. B"]
    texts, cut = [], set()
    for i in range(600):
        body = " ".join(rng.choice(frames).format(rng.randrange(2, 3000)) for _ in range(rng.randrange(3, 9)))
        if i % 5 == 0:
            body += rng.choice(["\n", " "]) + closings[i // 5 % len(closings)].format(rng.randrange(10, 999))
        elif i % 7 == 0:
            at = rng.randrange(len(body) // 2, len(body) - 2)
            while body[at - 1] in ". " or body[at : at + 1] in ".":
                at -= 1
            body = body[:at] + rng.choice(["", "", "…", " [...]", " (more)"])
            cut.add(i)
        texts.append((i, body, f"s{i % 3}"))
    return texts, cut


DOCS = "doc_id long, text string, source string"


def test_truncation_finds_cuts_and_spares_closing_lines(spark):
    texts, cut = corpus()
    odd = [(1000, None, "s0"), (1001, "", None), (1002, "n/a", "s0"), (1003, "No text.", "s1"), (1004, " " * 50, "s0"), (1005, "A quoted end”", "s0"), (1006, texts[7][1], "s0")]
    df = spark.createDataFrame(texts + odd + texts[:3], DOCS).withColumn("digest", F.lit(0)).withColumn("cut", F.lit("clash"))
    got = {r.doc_id for r in T.judged(df).where("cut").collect()}
    want = cut | ({1006} if 7 in cut else set())
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    assert not got & {1000, 1001, 1002, 1003, 1004, 1005}
    share = {r.source: r.share for r in T.by_source(T.judged(df)).collect()}
    assert set(share) == {"s0", "s1", "s2", None} and all(0 <= v < 0.5 for v in share.values())
    assert T.judged(df.limit(0)).count() == 0


def test_a_copy_shows_the_cut(spark):
    assert T.ends_early("one two three four five six seven eig", "one two three four five six seven eight nine.")
    assert T.ends_early("one two three four five six p = 0.", "one two three four five six p = 0.45 more.")
    assert not T.ends_early("one two three four five six seven.", "one two three four five six seven. Then more.")
    assert not T.ends_early("short", "short text")
    long = " ".join(f"Word{i} goes on with value {i * 7}." for i in range(40))
    df = spark.createDataFrame([(1, long, "s"), (2, long[:-20].rsplit(" ", 1)[0], "s"), (3, long + " Extra.", "t")], DOCS)
    got = {r.doc_id: (r.cut, r.evidence) for r in T.judged(df).collect()}
    assert got[2] == (True, "copy") and not got[1][0] and not got[3][0]


def test_a_copy_that_is_not_the_longest_shows_the_cut(spark, monkeypatch):
    body = " ".join(f"Word{i} goes on with value {i * 7}." for i in range(40))
    full = body + " The last line tells the whole story of the trial."
    cut = body + " The last line tells the whole story"  # ends lines without a stop elsewhere, so that its words show no cut
    closing = [(100 + i, f"Note {i}.\nThe last line tells the whole story", "t") for i in range(30)]
    longer = full + " " + " ".join(f"Other{i} is said here of matter {i * 3}." for i in range(60))
    variant = longer + " More words still."
    monkeypatch.setattr(T, "BUCKET", 2, raising=False)
    got = {r.doc_id: (r.cut, r.evidence) for r in T.judged(spark.createDataFrame([(1, full, "s"), (2, cut, "s"), (3, longer, "s"), (4, variant, "s"), *closing], DOCS)).collect()}
    assert got[2] == (True, "copy") and not any(got[i][0] for i in (1, 3, 4))


def test_long_text_is_judged_whole(spark):
    text = "The board met again in spring. " * 20_000
    df = spark.createDataFrame([(1, text, "s"), (2, text + "The board met aga", "s")], DOCS)
    assert rows(T.judged(df).select("doc_id", "cut")) == [(1, False), (2, True)]


def test_a_copy_twice_as_long_shows_the_cut(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    full = ". ".join(" ".join(words[i : i + 10]).capitalize() for i in range(0, 400, 10)) + "."
    at = full.index(words[155]) + 3  # inside a word, at less than half of the text
    edited = full[:at].replace(words[3], "other").replace(words[77], "word")
    whole = full[: full.index(".", at + 200) + 1]
    got = {r.doc_id: (r.cut, r.evidence) for r in T.judged(spark.createDataFrame([(1, full, "s"), (2, edited, "t"), (3, whole, "s")], DOCS)).collect()}
    assert got == {1: (False, None), 2: (True, "copy"), 3: (False, None)}


def test_contexts_are_counted_as_listed():
    import collections as c

    import pandas as pd

    texts = ["One two three. Four five\nsix 7 (more)", "A line\n\nB line ends", "", "One two"]
    want, ended = c.Counter(), c.Counter()
    for text in texts:
        bare, _ = T._tail(text)
        lines = bare.split("\n")
        for k, line in enumerate(lines):
            before, last = [], ()
            for toks in T.units(line):
                types = list(map(T.typed, toks))
                for last in T.contexts(before, types):
                    want.update(set(last))
                if types:
                    want[T.begins(types)] += 1
                before = types
            if last and not T._STOP.search(line.rstrip()):
                after = next((x for x in lines[k + 1 :] if x.strip()), None)
                if after is None or T._NEXT_LINE.match(after):
                    ended.update(set(last))
                    ended[T.begins(before)] += 1

    class Every:
        value = __import__("numpy").full(T.BITS // 64, -1)

    got = next(T._counter(Every)(iter([pd.DataFrame({"text": texts})])))
    assert dict(zip(got["context"], zip(got["n"], got["n_end"], strict=True), strict=True)) == {k: (n, ended[k]) for k, n in want.items()}


def test_texts_are_sketched_in_one_pass_and_marks_found_at_the_end():
    import random

    from papyrine.llm import truncation as U

    rng = random.Random(2)
    texts = ["", "one two", *[" ".join(rng.choice(["stone", "renal", "gene", "of", "a", f"w{i}"]) for _ in range(n)) for i, n in enumerate((5, 27, 28, 29, 52, 100, 500))]]
    assert U.sketched(texts) == [U.sketches(t) for t in texts]
    for t, (n, whole, beginnings, longest) in zip(texts, U.sketched(texts), strict=True):
        levels = sum(len(U.grams(t)) >= U.BEGINNING << k for k in range(8))
        assert n == len(U.shingles(t)) and len(whole) == U.BANDS * (n > 0) and len(beginnings) == U.BEGINNING_BANDS * levels
        assert longest == beginnings[len(beginnings) - U.BEGINNING_BANDS :][: len(longest)] and bool(longest) == bool(levels)
    a, b = U.sketched([texts[-1], texts[-1] + " and more of it"])
    assert a[2][: 6 * 4] == b[2][: 6 * 4]  # beginnings do not depend on what follows
    parts = ["[", "(", "]", ")", "…", "...", ".", "more", " ", "a", "truncated", " (more)", "[...]"]
    for _ in range(20_000):
        bare = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8))).strip()
        cut = U._MARK.sub("", bare)
        assert U._tail(bare) == (cut.rstrip(), cut != bare)


def test_cuts_that_repeat_in_a_large_corpus_are_found(spark):
    line = "Treatment of {0} was raised. Treatment of {0} went on. This study of {0} has ended. Neither {1} nor {2} was altered in the follow-up of {0}."
    whole = [(i, line.format(f"matter{i}", f"XAN{i}", f"SZR{i}"), "s") for i in range(300)]
    words = "saw heard told knew asked heeded warmed fed led met paid won".split()
    ends = ["Treatment", "This stud", "Neither KLM{0} nor S", "Neither KLM{0} nor SZR{0} was altered in the follow-", "He {1} {2} zw"]
    cuts = [(1000 + 10 * k + j, f"Treatment of thing{k}{j} was raised. {end.format(k, *words[2 * k : 2 * k + 2])}", "s") for j, end in enumerate(ends) for k in range(6)]
    lines = [(2000 + 10 * k + j, f"Treatment of issue{k}{j} was raised. {end.format(k)}", "t") for j, end in enumerate(["Unit {0}, Bldg. B", "Discussion", "Word count: {0}"]) for k in range(6)]
    got = {r.doc_id for r in T.judged(spark.createDataFrame(whole + cuts + lines, DOCS)).where("cut").collect()}
    assert got == {i for i, _, _ in cuts}
