import base64
import hashlib
import pathlib
import random
import re
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, fingerprints, language, shards, token_counts, toxicity, warc
from quillstone.llm._store import new_path

SF = "/root/testdata/sf0.01"
RNG = random.Random(11)
WORDS = ["Alpha", "beta", "GAMMA", "delta", "épsilon", "zêta", "eta", "theta", "iota", "kappa", "7", "漢字"]


def prose(n):
    return " ".join(RNG.choice(WORDS) + RNG.choice(["", ",", "."]) for _ in range(n))


# --- benchmark decontamination


def brute_contamination(text, items, n=10):
    def words(t):
        t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    own, hit, ids = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        size = min(n, len(w))
        for i in range(max(0, len(w) - size + 1) if w else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    ids.add(item_id)
    return len(own), len(hit), sorted(ids - {None}, key=str)


@pytest.fixture(scope="module")
def contaminated(spark):
    items = [(1, prose(25)), (2, prose(4)), (2, prose(12)), (10, ""), (11, None), (None, prose(11)), (12, "...")]
    docs = [(1, None), (2, ""), (3, "-- !!"), (4, items[0][1]), (5, "x " + items[0][1][10:] + " tail"), (6, items[1][1].upper()), (7, prose(60)), (7, prose(60)), (8, items[5][1]), (None, "Q" * 50_000 + " " + items[2][1] + " z")]
    return items, docs, spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame([(*r, "c", 3) for r in docs], "doc_id bigint, text string, spans string, n_hit int")


@pytest.mark.parametrize("block_nodes", [decontaminate.BLOCK_NODES, 900])
def test_contamination_is_that_of_brute_force(contaminated, block_nodes):
    items, docs, bench, df = contaminated
    got = decontaminate.contamination(df, bench, block_nodes=block_nodes).collect()
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(((r["id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=key) == sorted(((i, *brute_contamination(t, items)) for i, t in docs), key=key)
    whole = {i: t for i, t in docs}
    for r in got:
        for s in r["spans"]:
            if r["id"] not in (7,):
                assert decontaminate.normalised(whole[r["id"]][s["begin"] : s["end"]]).strip() in b" ".join(decontaminate.normalised(t).strip() for _, t in items)


def test_contamination_of_empty_tables(contaminated):
    _, docs, bench, df = contaminated
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(df, bench.limit(0)).collect()} == {0}


def test_ids_may_have_any_name_and_type(contaminated):
    items, _, bench, df = contaminated
    odd = df.select(F.struct(F.col("doc_id").alias("my col"), F.lit(1).alias("a`b.c")).alias("the row"), F.col("text").alias("own text"))
    got = decontaminate.contamination(odd, bench, id_col="the row", text_col="own text").collect()
    assert {r["id"]["my col"] for r in got if r["n_hit"]} >= {4, 5, 6, 8} and all(r["id"]["a`b.c"] == 1 for r in got)


def test_a_block_is_bounded_by_its_nodes(spark):
    items = [(i, " ".join(f"w{RNG.randrange(10**6)}" for _ in range(60))) for i in range(400)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = decontaminate.window_table(bench)
    nodes = table.agg(F.sum(F.length("window"))).first()[0]
    built = decontaminate.automaton((r["window"], r["item"]) for r in table.collect())
    assert table.count() == 400 * 51 and 0.3 * nodes < built.get_stats()["nodes_count"] <= nodes + 1
    docs = spark.createDataFrame([(i, "x " + t[40:] + " y") for i, t in items[:30]], "doc_id bigint, text string")
    got = decontaminate.contamination(docs, bench, block_nodes=nodes // 5).collect()
    assert sorted((r["id"], r["item_ids"]) for r in got) == [(i, [i]) for i in range(30)]


# --- toxicity


def test_a_clause_is_scored_and_not_its_words_alone():
    g = toxicity.Grammar({"idiot": 5.0, "scum*": 4.0})
    plain, target, denied, told = (g.weight(t) for t in ("an idiot", "you are an idiot", "not an idiot", "he said an idiot"))
    assert target > plain > denied > 0 and plain > told > 0
    assert g.weight("an idiot never") < plain and g.weight("an idiot, a bigger one than others, she wrote") < g.weight("an idiot, a bigger one than others, she found")
    assert g.weight("he isn’t an idiot") < g.weight("he is an idiot") == g.weight("he's an idiot")
    assert g.weight("Scumbag!") > 0 and g.weight("he said: you idiot") < g.weight("he saw: you idiot")
    text = "İ Fine. You IDIOT; bye"
    assert [text[b:e].strip() for b, e, _ in g.matched(text)] == ["You IDIOT"]
    assert g.weight(None) == g.weight("") == g.weight("nice") == 0


@pytest.mark.parametrize("text", ["I will kill you", "I will hurt you tonight", "they kill you", "we are killing them", "je vais te tuer", "ich werde dich töten", "te voy a matar", "I'll stab you", "on t'étranglera"])
def test_a_threat_needs_an_object(text):
    g = toxicity.Grammar()
    assert g.weight(text) > 0
    assert 0 < g.weight("he said " + text) < g.weight(text)
    assert g.weight("you should kill the process") == g.weight("kill the process") == 0
    assert g.weight("I will never kill you") < g.weight("I will kill you")


def test_harmless_uses_of_threats_verbs_weigh_less():
    g = toxicity.Grammar()
    threat = g.weight("I will kill you")
    for text in ("She beats her record", "He beats them at chess", "I shot him a message", "kill it for you", "It destroys your bugs"):
        assert g.score(g.weight(text)) < g.score(threat) / 2, text


def test_forms_of_threats_learn_from_labels(spark):
    assert toxicity.form_weight("kill", 0, 0) == 1.0 > toxicity.form_weight("beats", 0, 0) == 0.2
    assert toxicity.form_weight("beats", 40, 0) > 0.9 and toxicity.form_weight("kill", 0, 40) < 0.1
    toxic = [(f"moron number {i} and he beats you {i}", 1) for i in range(40)]
    usual = "and he has a number for you."
    clean = [(f"{usual} we will kill them at the game {i}", 0) for i in range(40)] + [(f"{usual} nobody beats eggs here {i}", 0) for i in range(80)]
    g = toxicity.fit(spark.createDataFrame(toxic + clean, "text string, toxic int"))
    assert g.threats["beats"] > 0.9 and g.threats["kill"] < 0.3 and set(g.threats) == {"beats", "kill"}
    assert g.fresh().word_class("beats") == (toxicity.THREATENS, g.threats["beats"])


def test_composition_is_what_its_parts_do_in_turn():
    one, two, three = toxicity.marker(toxicity.BEFORE_TARGET, toxicity.AIMED), toxicity.marker(toxicity.BEFORE_NEGATION, toxicity.DENIES, reach=2), toxicity.marker(toxicity.BEFORE_REPORT, toxicity.REPORTS, reach=None)
    whole = one.then(two).then(three).then(toxicity.teller())
    assert 4 < len(whole.arcs) <= 4 * 3 * 2
    for _ in range(300):
        symbols = [RNG.choice([0, 1, 2, 3, 4, toxicity.INSULT, toxicity.THREATENS, toxicity.THREATENS + toxicity.AFTER_TARGET]) for _ in range(RNG.randrange(12))]
        assert whole.run(symbols) == toxicity.teller().run(three.run(two.run(one.run(symbols))))


def brute_kinds(symbols):
    """The same by looking at each match's surroundings."""
    out = []
    for i, s in enumerate(symbols):
        if s < toxicity.INSULT:
            continue
        before, after = symbols[max(0, i - 3) : i], symbols[i + 1 : i + 4]
        deny_before, deny_after, told = toxicity.DENIES in before, toxicity.DENIES in after, toxicity.REPORTS in symbols
        rest = deny_before + 2 * deny_after + 4 * told
        whom = {toxicity.AIMED, toxicity.AIMED_OBJECT}
        if s == toxicity.INSULT:
            near = not (whom | {toxicity.OWNS}).isdisjoint(before + after)
            out.append(near + 2 * rest)
        elif not whom.isdisjoint(after[:2]) or toxicity.AIMED_OBJECT in before:
            out.append(16 + rest)
    return out


def test_kinds_are_those_of_looking_around_each_match():
    words = {0: "x", 1: "you", 2: "dich", 3: "not", 4: "said", 5: "your", toxicity.INSULT: "idiot", toxicity.THREATENS: "kill"}
    g = toxicity.Grammar({"idiot": 1.0})
    for _ in range(2000):
        symbols = [RNG.choice(list(words)) for _ in range(RNG.randrange(15))]
        assert [k for k, _ in g.kinds([words[s] for s in symbols])] == brute_kinds(symbols)


def test_gains_are_learned():
    """Where insults under negation are never toxic and others always are, the fit says so beyond the prior."""
    import numpy as np

    profiles = np.zeros((4, toxicity.KINDS))
    profiles[0, 0], profiles[1, 2], profiles[2, 16], labels = 5, 5, 1, np.array([1.0, 0, 1, 0])
    slope, bias, gains = toxicity.fitted_line(profiles, labels, np.array([300.0, 300, 300, 300]))
    g = toxicity.Grammar({}, slope, bias, tuple(gains))
    scores = [g.score(float(np.log1p(p @ np.exp(toxicity.DESIGN @ gains)))) for p in profiles]
    assert gains[1] < toxicity.PRIOR[1] and scores[0] > 0.9 > 0.5 > scores[1] and scores[2] > 0.9 and scores[3] < 0.1


def test_scores_of_odd_rows_and_of_no_labels(spark):
    rows = [(1, None, 0.5), (2, "", 1.0), (3, "moron " * 20_000, 2.0), (3, "moron", 2.0), (None, "fine", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    out = toxicity.scored(df, toxicity.Grammar({"moron": 6.0})).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert out[0]["score"] == out[1]["score"] == out[4]["score"] < out[3]["score"]
    none = spark.createDataFrame([], "text string, toxic int")
    assert toxicity.fit(none).weights == {}
    assert toxicity.fit(spark.createDataFrame([("a b", 1), ("c", None)], "text string, toxic int")).weights == {}
    assert toxicity.scored(df.limit(0), toxicity.Grammar()).count() == 0


def test_a_score_of_seven_tenths_is_toxic(spark):
    folder = tempfile.mkdtemp(prefix="quillstone-")
    spark.createDataFrame([(i, "fine words" if i % 2 else "you moron") for i in range(40)], "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = toxicity.op2_toxicity(spark, folder).collect()
    assert len(rows) == 40 and all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert {r["predicted"] for r in rows if r["doc_id"] % 2} == {0}


def test_held_out_toxicity(spark):
    found = toxicity.op2_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    hits, said, true = found.agg(F.expr("count_if(predicted = 1 AND toxic = 1)"), F.expr("count_if(predicted = 1)"), F.expr("count_if(toxic = 1)")).first()
    assert hits / said > 0.9 and hits / true > 0.8


# --- language


def test_language_of_odd_rows(spark):
    contents = {"en": b" the and of that with " * 50, "fr": b" le la les des avec que " * 50}
    rows = [(1, None), (2, ""), (3, "123 ... 45"), (4, "the and of that"), (5, "LES DES AVEC QUE"), (5, "LES DES AVEC QUE"), (6, "the of " * 30_000), (None, "zz")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang_pred string")
    out = [(r["lang_pred"], r["lang_rejected"]) for r in language.identified(df, contents).collect()]
    assert out[:3] == [("und", True)] * 3 and out[3:7] == [("en", False), ("fr", False), ("fr", False), ("en", False)] and out[7][0] in contents
    assert {r["lang_pred"] for r in language.identified(df, {}).collect()} == {"und"}
    assert language.fit(df.select("text", F.lit(None).cast("string").alias("lang"))) == {} and language.identified(df.limit(0), contents).count() == 0


def test_a_narrow_margin_is_rejected(spark):
    contents = {"a": b" one two three four five six " * 40, "b": b" one two three four five six " * 40}
    df = spark.createDataFrame([("one two three four five six one two three",)], "text string")
    assert language.identified(df, contents).first()["lang_rejected"]


def test_copies_do_not_displace_a_language(spark):
    copies = spark.range(20_000).select(F.lit("one and the same text again").alias("text"), F.lit("fr").alias("lang"))
    others = spark.createDataFrame([("".join(chr(97 + int(d)) for d in f"{i:04d}") * 3, "fr") for i in range(300)] + [("words of another", "en")] * 3, "text string, lang string")
    contents = language.fit(copies.unionByName(others))
    assert len(set(contents["fr"].split())) >= language.SAMPLE_ROWS
    assert contents["en"] == b" words of another "


def test_dictionaries_learn_from_whole_texts(spark):
    texts = ["1 2 " * 3000 + "late words here", *("begin " * 1000 + f"{c} " * 9000 for c in "abcdefgh")]
    contents = language.fit(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"))
    assert b" late words here " in contents["en"] and sum(f" {c} {c} ".encode() in contents["en"] for c in "abcdefgh") >= 4


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.op9_language(spark, SF).where("held_out").join(docs, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


# --- token counts


def greedy(vocabulary, word):
    text, n, at = [*word, -1], 0, 0
    known = {(*body, -1) if closes else tuple(body) for body, closes in vocabulary}
    while at < len(text):
        size = next((s for s in range(len(text) - at, 0, -1) if tuple(text[at : at + s]) in known), 0)
        if not size:
            return 1
        n, at = n + 1, at + size
    return n


def test_counts_are_those_of_greedy_longest_match(spark):
    rng = random.Random(3)
    pieces = {(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))), rng.random() < 0.4) for _ in range(60)}
    automaton = token_counts.LongestMatch(pieces)
    for _ in range(3000):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        assert automaton.count(word) == greedy(pieces, word), word
    own = token_counts.pieces(token_counts.vocabulary_path())
    real = token_counts.LongestMatch(own)
    for word in ("the", "question", "ünïcode", "漢字", "a" * 200):
        assert real.count(word.encode()) == greedy(own, word.encode())
    rows = [(1, None, 1), (2, "", 1), (3, "The the\tthe", 1), (3, "The the\tthe", 1), (4, "x" * 50_000, 1)]
    out = token_counts.counted(spark.createDataFrame(rows, "doc_id int, text string, n_tokens int"), token_counts.vocabulary_path()).collect()
    assert token_counts.counted(spark.createDataFrame([], "doc_id int, text string"), token_counts.vocabulary_path()).count() == 0
    assert [(r["n_words"], r["n_tokens"]) for r in out[:4]] == [(0, 0), (0, 0), (3, 3), (3, 3)] and out[4]["n_words"] == 1


# --- sharding


def check_shards(rows, n_shards, ids):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, ids))
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(0 <= s < n_shards for s in by)
    counts = [len(by.get(i, [])) for i in range(n_shards)]
    assert max(counts) - min(counts) <= 1


def test_shards_hold_every_row_once_and_evenly(spark):
    rows = [(i, "same text" if i % 3 == 0 else prose(i % 30), "s", i) for i in range(500)] + [(None, None, None, 1), (7, "", "s", 2), (7, "", "s", 2), (900, "y" * 80_000, "s", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard string, row int")
    ids = [r[0] for r in rows]
    one = shards.shuffled(df, 40, bucket_bytes=3000).collect()
    check_shards(one, 40, ids)
    again = shards.shuffled(df.repartition(7), 40, bucket_bytes=3000).collect()
    spot = lambda rows: sorted((str(r["doc_id"]), r["text"] or "", r["shard"], r["slot"]) for r in rows)
    assert spot(one) == spot(again)
    assert spot(one) != spot(shards.shuffled(df, 40, seed=18, bucket_bytes=3000).collect())
    same = [r["shard"] for r in one if r["text"] == "same text"]
    assert len(set(same)) > 30
    check_shards(shards.shuffled(df.limit(5), 40).collect(), 40, [r["doc_id"] for r in df.limit(5).collect()])
    assert shards.shuffled(df.limit(0), 40).count() == 0
    path = new_path(spark, "shards")
    written = shards.write_shards(df, path, 4, bucket_bytes=3000)
    assert written.count() == len(rows) and written.where("shard = 0").count() in (125, 126)
    for f in pathlib.Path(path.removeprefix("file://")).rglob("*.parquet"):
        slots = pq.read_table(f)["slot"].to_pylist()
        assert slots == list(range(slots[0], slots[0] + len(slots)))


def test_repeated_rows_are_scattered(spark, monkeypatch):
    monkeypatch.setattr(shards, "HOT_COPIES", 50)
    rows = [(None, "one and the same row")] * 900 + [(i, "a text of its own") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = shards.shuffled(df, 7, bucket_bytes=2000).collect()
    check_shards(got, 7, [r[0] for r in rows])
    same = [r["shard"] for r in got if r["doc_id"] is None]
    assert min(same.count(i) for i in range(7)) > 80
    _, each = shards._scattered(df, "text", 17)
    assert each.agg(F.max("n"), F.sum("n")).first() == (1, 1200)


# --- WARC


def test_archives_round_trip(spark):
    html = ["<p>a</p>", "<p>b</p>", "", None, "ü" * 70_000, "<p>a</p>"]
    rows = [(i, f"http://x/{i} y\r\nz" if i % 4 else None, html[i % len(html)], "t") for i in range(60)] + [(3, "http://again", "<p>b</p>", "t"), (None, "u", "alone", "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string")
    folder = new_path(spark, "warc")
    assert warc.write_archives(pages, folder).agg(F.sum("records")).first()[0] == len(rows)
    back = warc.read_archives(spark, folder, verify="true").collect()
    assert len(back) == len(rows)
    first = {}
    for i, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", i)
    for r in back:
        i = int(r["record_id"].rpartition(":")[2]) if r["record_id"] != "urn:page:" else None
        own = {(h or "").encode() for j, _, h, _ in rows if j == i}
        if r["record_type"] == "response":
            assert r["payload"] in own and len(r["payload"]) == r["payload_length"] and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == r["payload_digest"]
            assert i is None or first[r["payload"].decode()] == i
        else:
            assert r["payload"] is None and int(r["refers_to"].rpartition(":")[2]) in first.values()
    assert sum(r["record_type"] == "response" for r in back) == len(first)


def test_header_predicates_are_pushed_down(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "same" if i % 2 else f"p{i}") for i in range(20)], "page_id bigint, url string, html string")
    folder = new_path(spark, "warc")
    warc.write_archives(pages, folder)
    source = warc.read_archives(spark, folder)
    assert source.where("record_type = 'revisit'").count() == 9
    assert [r["payload"] for r in source.where("target_uri = 'http://x/4'").collect()] == [b"p4"]
    assert source.where("record_type IN ('response') AND refers_to IS NULL AND content_length > 0").count() == 11
    assert {r["payload"] for r in warc.read_archives(spark, folder, payload="false").collect()} == {None}
    kept = warc.WarcReader({"path": folder})
    left = list(kept.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"x")]))
    assert len(left) == 1 and len(kept.tests) == 1


def test_archives_roll_over_and_a_payload_may_be_half_of_all(spark):
    rows = [(i, f"http://x/{i}", "the same page " * 40 if i % 2 else f"page {i} " * 30) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    folder = new_path(spark, "warc")
    made = warc.write_archives(pages, folder, archive_bytes=20_000).collect()
    assert len(made) > 8 and sum(r["records"] for r in made) == 400 and max(r["records"] for r in made) < 120
    back = warc.read_archives(spark, folder, verify="true")
    assert back.where("record_type = 'revisit'").agg(F.count("*"), F.min("refers_to"), F.max("refers_to")).first() == (199, "urn:page:1", "urn:page:1")
    assert back.select("record_id").distinct().count() == 400


def test_no_pages_and_small_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id bigint, url string, html string")
    folder = new_path(spark, "warc")
    warc.write_archives(pages.limit(0), folder)
    assert warc.read_archives(spark, folder).count() == 0
    other = new_path(spark, "warc")
    warc.write_archives(pages, other, min_bytes=10)
    assert {r["record_type"] for r in warc.read_archives(spark, other).collect()} == {"response"}


# --- fingerprints


def brute_edits(rows, tie):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1] or ""], r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((doc_id, len(text), edited))
    return sorted(out, key=str)


def ties(spark, rows):
    df = spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "text string")
    return {r["text"]: r["tie"] for r in df.select("text", fingerprints._tie(F.col("text")).alias("tie")).collect()}


@pytest.mark.parametrize("run_bytes", [8 << 20, 3000])
def test_edits_and_fingerprints(spark, run_bytes):
    rows = [(i * 3, prose(i % 40)) for i in range(150)] + [(9, "twice"), (9, "twice"), (None, "no id"), (2000, None), (2001, ""), (2002, "漢" * 9000), (150, "head again"), (-(1 << 63), "least"), ((1 << 63) - 1, "most"), ((1 << 63) - 2, "but one")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, fingerprint string")
    got = fingerprints.with_edits(df, run_bytes=run_bytes).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_text"]) for r in got), key=str) == brute_edits(rows, ties(spark, rows))
    by_text = {}
    for r in got:
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if r["doc_id"] not in (9, 150):  # ids of two texts each
            by_text.setdefault(next(t or "" for i, t in rows if i == r["doc_id"]), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(r["near_edited"] for r in got) > 2 * sum(r["near_next"] for r in got)


def test_a_third_of_all_rows_may_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "HOT_COPIES", 40)
    rows = [(i, prose(12)) for i in range(200)] + [(77, prose(9)) for _ in range(150)] + [(None, prose(9)) for _ in range(150)] + [(77, "the same row")] * 100 + [(None, None)] * 100
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    facts = fingerprints.signed(df)
    cuts, hot = fingerprints._units(facts, sum(len((t or "").encode()) for _, t in rows), 2000)
    assert {r["doc_id"] for r in hot.where("parts > 1").collect()} == {77, None} and 77.0 in cuts
    got = fingerprints.with_edits(df, facts, run_bytes=2000).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_text"]) for r in got), key=str) == brute_edits(rows, ties(spark, rows))


def near_classes(rows):
    """Smallest ids that links of 0.8 lead to, by brute force, of the documents that have a smaller one."""
    sets = {i: {tuple(["", "", "", "", *t.split()][j : j + 5]) for j in range(len(t.split()))} for i, t in rows if i is not None and (t or "").split()}
    found = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    while True:
        new = dict(found)
        for i, j in links:
            new[i] = new[j] = min(new[i], new[j])
        if new == found:
            return {i: c for i, c in found.items() if c < i}
        found = new


def test_near_texts_are_classes_of_links_verified(spark):
    base = [" ".join(f"b{i}w{j}" for j in range(60)) for i in range(12)]
    rows = [(i * 20, b) for i, b in enumerate(base)] + [(1000 + i, b + " and one") for i, b in enumerate(base[:8])] + [(2000 + i, b) for i, b in enumerate(base[8:10])]
    rows += [(5000 + j, base[0] + f" x{j}") for j in range(60)] + [(400, None), (420, ""), (440, "one"), (460, " "), (None, base[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sketches = fingerprints.signed(df)
    near = {r["doc_id"]: r["near_class"] for r in fingerprints.linked(df, sketches).collect()}
    assert near == near_classes(rows) and len(near) == 70
    rode = fingerprints.with_edits(df, sketches, spark.createDataFrame(list(near.items()), "doc_id bigint, near_class bigint"), run_bytes=3000).collect()
    assert sorted(((r["doc_id"], r["near_class"]) for r in rode), key=str) == sorted(((i, near.get(i, i)) for i, _ in rows), key=str)


def test_near_texts_are_found_among_relatives_that_are_not_near(spark):
    """Each text has one near to it between many relatives below the threshold, of smaller and of larger ids."""
    rng, rows = random.Random(80), []
    for q in range(40):
        words = [f"q{q}w{j}" for j in range(200)]
        rows.append((10_000 + q * 20, " ".join(words)))
        near = list(words)
        near[rng.randrange(200)] = "changed"
        rows.append((20_001 + q * 20, " ".join(near)))
        for r in range(60):
            relative, at = list(words), rng.sample(range(200), rng.choice([12, 16, 20]))
            for i in at:
                relative[i] = f"r{q}x{r}y{i}"
            rows.append(((q * 100 + r) * 20 + 7 if r % 2 else 1_000_000 + (q * 100 + r) * 20 + 7, " ".join(relative)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    near = {r["doc_id"]: r["near_class"] for r in fingerprints.linked(df, fingerprints.signed(df)).collect()}
    assert near == {20_001 + q * 20: 10_000 + q * 20 for q in range(40)}


@pytest.mark.parametrize("block", [1024, 8])
def test_no_link_of_a_family_across_the_threshold_is_left_out(spark, monkeypatch, block):
    """Families whose members lie on both sides of the threshold: classes are those of all links, not of queries' alone."""
    monkeypatch.setattr(fingerprints.near_dedup, "BLOCK", block)
    rng, rows = random.Random(8), []
    for family in range(6):
        words = [f"f{family}w{j}" for j in range(100)]
        for i in range(50):
            own = list(words)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**6) * 6 + family, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    near = {r["doc_id"]: r["near_class"] for r in fingerprints.linked(df, fingerprints.signed(df)).collect()}
    assert near == near_classes(rows) and len(near) > 150


def test_equal_sets_are_one_class_and_near(spark):
    rows = [(i, "the same words in all of these") for i in range(20, 400, 7)] + [(40, "the same words in all of these"), (1000, "another text of its own here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    near = {r["doc_id"]: r["near_class"] for r in fingerprints.linked(df, fingerprints.signed(df)).collect()}
    assert near == {i: 20 for i in {r[0] for r in rows[1:-1]}}


def test_similar_finds_nine_in_ten_of_brute_force(spark):
    rng, rows = random.Random(6), []
    for family in range(40):
        words = [f"f{family}w{j}" for j in range(110)]
        for copy in range(6):
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(110)] = f"e{rng.randrange(10**6)}"
            rows.append((family * 10 + copy, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    shingles = {i: {tuple((["", "", "", "", *t.split()])[j : j + 5]) for j in range(110)} for i, t in rows}
    by_text, want = {}, set()
    for i, t in rows:
        by_text.setdefault(t, i)
    for q in (i for i, _ in rows if i % 20 == 0):
        want |= {(q, i) for i in by_text.values() if i != q and dict(rows)[i] != dict(rows)[q] and len(shingles[q] & shingles[i]) >= 0.8 * len(shingles[q] | shingles[i])}
    got = {(r["query_id"], r["id"]) for r in fingerprints.similar(df.where("doc_id % 20 = 0"), df).where("jaccard < 1").collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 20


def test_fingerprints_of_few_rows(spark):
    df = spark.createDataFrame([(5, "one row of text")], "doc_id bigint, text string")
    r = fingerprints.with_edits(df).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1 and r[0]["edited_text"] == "one row one row"
    assert fingerprints.with_edits(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "c d")], "doc_id bigint, text string")
    assert sorted(x["edited_text"] for x in fingerprints.with_edits(nulls).collect()) == ["a c", "c a"]
    clash = spark.createDataFrame([(1, "a b", 2, 3)], "doc_id bigint, text string, fingerprint int, `my col` int")
    assert fingerprints.fingerprinted(clash).columns == ["doc_id", "text", "my col", "fingerprint"] and fingerprints.fingerprinted(clash.limit(0)).count() == 0
    assert fingerprints.similar(clash.limit(0), clash).count() == fingerprints.similar(clash, clash).count() == 0


def test_similar_texts_are_those_of_brute_force(spark):
    base = [prose(60) for _ in range(8)]
    rows = [(i, b) for i, b in enumerate(base)] + [(100 + i, b + " one more") for i, b in enumerate(base)] + [(200, None), (201, ""), (202, base[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["query_id"], r["id"]) for r in fingerprints.similar(df.where("doc_id < 4"), df).collect()}
    assert {(i, 100 + i) for i in range(4)} <= got and all(a != b for a, b in got)


def test_similar_texts_with_copies_other_shingles_and_thresholds(spark):
    words = [[f"t{i}w{j}" for j in range(40)] for i in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    rows += [(100 + i, " ".join(w[:22])) for i, w in enumerate(words)]  # 22 of 40 shingles are shared
    rows += [(202, rows[0][1]), (203, rows[0][1]), (204, " ".join(reversed(words[1]))), (205, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    few = df.where("doc_id < 60 OR doc_id = 205")
    found = lambda **options: {(r["query_id"], r["id"]) for r in fingerprints.similar(few, df, **options).collect()}
    assert found() == {(0, 202)}
    assert found(threshold=0.5) == {(0, 202), *((i, 100 + i) for i in range(60))}
    assert found(k=1) == {(0, 202), (1, 204)}
    members = {r["id"]: r["representative"] for r in fingerprints.copies(df).collect()}
    assert len(members) == len(rows) and {i for i, m in members.items() if m == 0} == {0, 202, 203}


def test_numerals_are_no_letters():
    assert [language.letters(t) for t in ("½", "① ②", "ⅷ", "12 ٣", "²", "", None)] == [b""] * 7
    assert language.letters("½ a") == b" \xc2\xbd a " and language.letters("ª") and language.letters("字")


def test_long_words_are_counted_but_not_remembered():
    counts = token_counts.Counts(token_counts.LongestMatch([(b"ab", False), (b"ab", True), (b"a", False), (b"b", True)]))
    long = b"ab" * 500_000
    assert counts[long] == 500_000 and not counts
    assert counts[b"ab"] == 1 and list(counts) == [b"ab"]
    grammar = toxicity.Grammar({"w:bad": 1.0}, 1.0, 0.0)
    for i in range(50):
        grammar.word_class("x" * 1000 + str(i))
    assert not grammar._classes


def test_a_window_of_very_many_items_costs_no_more_without_spans():
    words = " ".join(f"w{i}" for i in range(10))
    built = decontaminate.automaton((w, i) for i in range(2000) for w in decontaminate.windows(words))
    text = " and ".join([words] * 40)
    n, hit, ids, spans = decontaminate.spans_of(text, built)
    assert len(spans) == 80_000 and hit == 400 and ids == sorted(range(2000), key=str)
    assert decontaminate.spans_of(text, built, spans=False) == (n, hit, ids, [])


def test_runs_in_other_threads_keep_their_tables(spark):
    import threading

    from quillstone.llm import _store

    inside, left, rows = threading.Event(), threading.Event(), {}

    def other():
        inside.wait(30)
        kept = _store.written(spark.range(5), "other")
        left.wait(30)
        rows["other"] = kept.count()

    thread = threading.Thread(target=other)
    thread.start()
    with _store.discarded():
        gone = _store.written(spark.range(3), "mine")
        inside.set()
        while not rows and thread.is_alive() and not left.is_set():
            left.wait(2)
            left.set()
    thread.join(60)
    assert rows == {"other": 5}
    with pytest.raises(Exception, match="(?i)not exist|no such"):
        gone.count()
