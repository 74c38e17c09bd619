"""Leaks, mixing and text statistics: against brute force, on empty, null, long and repeated texts."""

import json
import random
import re
import signal
from contextlib import contextmanager

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.llm import leakage, mixing
from codeweft.llm.leakage import WORD, build, leak_pairs, leaks, remove_leaks
from codeweft.llm.mixing import LEAST_WEIGHT, TOKENIZER, TokenCounter, by_pieces, canonical_source, mix, plan, quality_weight, shares, sized
from codeweft.llm.text_quality import STATS, WEIGHTS, _line, autocorrelation, prose_share, prose_verdicts, statistics, text_quality

DOCS = "doc_id bigint, text string, source string, tokens string"


def brute(docs, items, least):
    grams = {}
    for i, t in items:
        w = [x.lower() for x in WORD.findall(t)]
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for d, t in docs:
        w = [x.lower() for x in WORD.findall(t)]
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + least]), ())}
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(2, 5))
def test_automaton_equals_brute_force(items, doc, least):
    named = [(k, " ".join(x)) for k, x in enumerate(items)]
    text = " ".join(doc)
    made = list(build(named, least))
    _, spans, best = leakage.found(text, made[0]) if made else (0, [], [])
    assert {(0, i) for i, *_ in best} == brute([(0, text)], named, least)
    for i, run, s, e in best:
        assert len(text[s:e].split()) == run and text[s:e] in named[i][1]
        longest = max(n for n in range(least, len(doc) + 1) for k in range(len(doc) - n + 1) if f" {' '.join(doc[k : k + n])} " in f" {named[i][1]} ")
        assert run == longest
    covered = set()
    for k in range(len(doc) - least + 1):
        if any(f" {' '.join(doc[k : k + least])} " in f" {t} " for _, t in named):
            covered |= set(range(k, k + least))
    assert {k for s, e in spans for k in range(s // 2, (e + 1) // 2)} == covered
    assert leakage.merge_spans([{"s": s, "e": e} for s, e in spans]) == spans
    assert leakage.cut_out(text, [{"s": s, "e": e} for s, e in spans], 1.0)[:2] == (len(doc), len(covered))


def test_items_are_cut_into_bounded_automata(monkeypatch):
    monkeypatch.setattr(leakage, "SHARD", 20)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(15))) for k in range(4)]
    automata = list(build(items, 12))
    assert len(automata) == 4
    assert [[i for i, *_ in leakage.found(items[2][1].upper(), a)[2]] for a in automata] == [[], [], [2], []]


def test_several_automata_give_what_one_gives(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(9)]
    items = [(k, " ".join(rnd.choices(words, k=14))) for k in range(12)]
    docs = [(k, " ".join(rnd.choices(words, k=6) + items[k % 12][1].split()[: 3 + k % 12] + items[(k * 5 + 1) % 12][1].split()[2:] + rnd.choices(words, k=5)), None, "x") for k in range(40)]
    docs += [(0, docs[0][1], None, "x"), (None, docs[1][1], None, "x"), (90, None, None, "x"), (91, "", None, "x")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")

    def all_of():
        return (
            sorted(map(tuple, leak_pairs(d, i, 5).collect())),
            sorted((r.doc_id, r.n_words, r.leaked_words, [x[:2] for x in r["items"]]) for r in leaks(d, i, 5).collect()),
            sorted(map(tuple, remove_leaks(d, i, 5).collect()), key=str),
        )

    one = all_of()
    monkeypatch.setattr(leakage, "SHARD", 40)
    assert len(leakage._automata(i, 5)) == 6 and all_of() == one and len(one[2]) == len(docs)


def test_leaks_and_cleaning(spark):
    item = "What does the planner do once the sparse window of Kibre is moved below the order"
    docs = [(1, f"Intro text. {item.upper().replace(' ', ', ')}! The end of it all is here and goes on for quite some time until it has many more words than that.", None, "x"), (2, " ".join(item.split()[:11]), None, "x"), (3, item, None, "x"), (3, item, None, "x"), (4, None, None, "x"), (5, "", None, "x"), (None, item, None, "x"), (6, "K" + item[1:], None, "x")]
    items = [(10, item), (11, item.replace("What", "Who") + " and more"), (12, "too short to count"), (13, None), (10, item)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(tuple(r) for r in leak_pairs(d, i).collect()) == [(1, 10), (1, 11), (3, 10), (3, 11), (6, 10), (6, 11)]
    r = leaks(d, i).where("doc_id = 1").first()
    assert {x.item_id: x.longest for x in r["items"]} == {10: 16, 11: 15} and r.leaked_words == 16
    clean = {x.doc_id: x for x in remove_leaks(d, i).collect()}
    assert clean[1].text.startswith("Intro text. !") and "PLANNER" not in clean[1].text and clean[3].dropped and clean[3].text is None and clean[4].text is None and clean[5].text == "" and None in clean and clean[2].text == docs[1][1]
    assert leak_pairs(d.limit(0), i).count() == 0 and leak_pairs(d, i.limit(0)).count() == 0


PROSE = "If the ledger is missing, the carrier is skipped and a warning appears in the build report. We measured 12 ms for a local window, which surprised me."


@pytest.mark.parametrize("text", [
    PROSE, PROSE.upper(), PROSE.replace(" ", "\n", 40), "# Title\n\n" + PROSE + "\n\n- one thing\n- other thing\n\n" + PROSE, PROSE + "\n\n```\nrun --fast 1\n```\n",
    "Wenn das Paket fehlt, läuft der Aufbau weiter und im Bericht steht nur eine Warnung. Niemand weiß mehr genau, warum.", "Nadie recuerda por qué el servicio escribe dos veces el mismo valor, pero quitarlo rompe las pruebas.", "Q: " + PROSE + "\n\nA: " + PROSE,
])
def test_prose(text):
    assert statistics(text)[-1]


@pytest.mark.parametrize("text", [
    None, "", " \n\t ", "| a | b | count |\n|---|---|---:|\n" + "\n".join(f"| row{k} | local | {k * 37} |" for k in range(12)), "id,name,weight\n" + "\n".join(f"{k},ledger,{k}.5" for k in range(15)),
    "\n".join(f"- local window {k}" for k in range(12)), "\n".join(f"2025-01-0{k}T10:00:0{k}Z INFO edge={k} node=0x{k}f" for k in range(1, 9)), "panic: nil\n" + "\n".join(f"  at core.run_it (api/x.go:{k})" for k in range(10)),
    "└── a.go\n├── b.go\n│   └── c.go\n" * 4, "rjtvCdb10E/dCIX2DzekdJ8ZfX79NK7UiAuy" * 9, "#### " * 40, "drain manifest " * 40, "schema endpoint budget column order signal edge symbol session summary channel journal " * 3,
    "\n".join(f"manifest_lease_{k}: {v}" for k, v in enumerate(["true", "null", "5", "local"] * 4)), "ØcoãÐse½Ð ½€tiïpa¿mo Ð¿ ¶Þ™bu §¿ ¶enØor¾se½Ø Ø€€fr ™¿¿¿¾€ ±â¾ânoÐreÐÂ" * 3,
])
def test_not_prose(text):
    assert not statistics(text)[-1]


@pytest.mark.parametrize("text", [
    "Если журнал отсутствует, перевозчик пропускается, и в отчёте появляется предупреждение. Мы измерили двенадцать миллисекунд для локального окна, что меня удивило.",
    "如果账本丢失,系统会跳过载体,并在构建报告中显示警告。我们测得本地窗口需要十二毫秒,这让我感到惊讶。", "यदि खाता बही गायब है, तो वाहक को छोड़ दिया जाता है और निर्माण रिपोर्ट में एक चेतावनी दिखाई देती है। हमने स्थानीय विंडो के लिए बारह मिलीसेकंड मापा।",
    "หากบัญชีแยกประเภทหายไป ผู้ให้บริการจะถูกข้ามไปและคำเตือนจะปรากฏในรายงานการสร้าง เราวัดได้สิบสองมิลลิวินาทีสำหรับหน้าต่างท้องถิ่น", "إذا كان السجل مفقودا، يتم تخطي الناقل ويظهر تحذير في تقرير البناء. لقد قمنا بقياس اثني عشر ميلي ثانية.",
    "Jeśli brakuje rejestru, przewoźnik jest pomijany, a w raporcie pojawia się ostrzeżenie.",
])
def test_prose_without_a_word_list(text):
    assert statistics(text)[-1] and statistics(text, {**WEIGHTS, "common": 0})[-1]


RECORDS = "\n".join(f"{a}\nThe Old Bakery Street\nTown" for a in ("Mary Smith", "Jo Brown", "Al Gray", "Su Green", "Bo White", "Ed Black", "Di Reed", "Ty Long"))
OUTLINE = "\n".join(f"{a} office\n    {b} people\n    rather {c} people" for a, b, c in zip(("Mary", "Johanna", "Al", "Susan", "Bo", "Edward", "Di", "Tyrone"), ("old", "oldest", "new", "newest", "big", "biggest", "bad", "worst"), ("grown", "red", "green", "blue", "amber", "tall", "thin", "calm")))


def test_each_layout_signal_decides_alone():
    rows = "\n".join(f"- {x}" for x in ("local window", "a bucket that nobody owns", "ledger", "the carrier", "most of the other signals"))
    for text, signal in ((rows, "alignment"), (RECORDS, "length_period"), (OUTLINE, "indent_period")):
        assert not statistics(text)[-1]
        others = {**WEIGHTS, "alignment": 0, "indent_period": 0, "length_period": 0}
        assert statistics(text, others)[-1] and not statistics(text, {**others, signal: WEIGHTS[signal]})[-1], signal


def test_autocorrelation_finds_long_periods():
    import numpy as np

    for period in (2, 5, 7):
        x = np.array(([0.0] + [2.0] * (period - 1)) * 6)
        assert autocorrelation(x) > 0.9
    assert autocorrelation(np.ones(9)) == 1.0 and autocorrelation(np.array([1.0, 2.0])) == 0.0


@contextmanager
def within(seconds):
    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


@pytest.mark.parametrize("text", [
    "Most questions about the column come from people who have not read the page on sessions, which is short.", "a" * 50 + "-", "abc " * 5_000 + "*", "a1." * 20_000 + "_", "x" + " " * 50_000 + "\tx",
    "a" + "\"" * 50_000 + "x", "a" + ".!" * 30_000 + "x", "a" + ".)" * 30_000 + "x", "-" * 50_000, "ü" * 50_000 + "-",
])
def test_time_grows_with_length_only(text):
    with within(10):
        statistics(text)
        quality_weight(text)


MARKS = re.compile(r"[^\w\s'\"’“”„«»¿¡…!?.,-]|_|(?<=\w)[.,](?=\w)|,|(?<![^\W_])-|-(?![^\W_])| {2,}(?=\S)|\t")


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab9 _-.,'’!|:\t\x1c\xa0éЖ中।½"), max_size=30))
def test_marks_of_a_line(x):
    x = x.rstrip()
    if x:
        assert _line(x).marks == [(" " if m.group()[0] == " " else m.group(), m.end()) for m in MARKS.finditer(x, len(x) - len(x.lstrip()))]


def test_a_dot_inside_a_name_is_a_mark():
    assert _line("main.go").marks == [(".", 5)] and _line("one two 3. Four!").marks == []


def test_verdicts_are_those_of_the_statistics(spark):
    rows = [(1, PROSE, None, "x"), (1, PROSE, None, "x"), (2, None, None, "x"), (None, PROSE, None, "x"), (3, RECORDS, None, "x"), (4, PROSE + "\n\n" + RECORDS, None, "x"), (5, " ", None, "x")]
    d = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, prose_verdicts(d).collect())) == sorted(map(tuple, text_quality(d).select("doc_id", "prose_share", "is_prose").collect()))


def test_quality_weight():
    table = "| a | b | count |\n|---|---|---:|\n" + "\n".join(f"| row{k} | local | {k * 37} |" for k in range(12))
    assert quality_weight(PROSE) == 1.0 and quality_weight(table) == quality_weight(None) == LEAST_WEIGHT
    assert abs(quality_weight(PROSE + "\n\n" + table) - prose_share(PROSE + "\n\n" + table)) < 1e-9 < 0.3


def test_statistics_rows(spark):
    rows = [(1, PROSE, None, "x"), (1, PROSE, None, "x"), (2, None, None, "x"), (None, PROSE, None, "x"), (3, "word " * 200_000, None, "x")]
    got = text_quality(spark.createDataFrame(rows, DOCS))
    assert sorted((r.doc_id, r.is_prose) for r in got.collect()) == [(1, True), (1, True), (2, False), (3, False)]
    assert {r.doc_id: r.n_words for r in got.collect()} == {1: 28, 2: 0, 3: 200_000} and len(got.columns) == 1 + len(STATS)
    assert text_quality(spark.createDataFrame([], DOCS)).count() == 0


def test_plan():
    targets = [("a", 0.5, 1), ("b", 0.25, 4), ("none", 0.25, 9)]
    out = {p["source"]: p for p in plan({"a": 1000, "b": 200}, targets)}
    assert out["a"]["budget"] == 1000 and out["b"]["budget"] == 500 and (out["b"]["epochs"], out["b"]["rest"]) == (2, 100) and out["none"]["budget"] == 0
    capped = {p["source"]: p["budget"] for p in plan({"a": 1000, "b": 200}, targets, 10_000)}
    assert capped == {"a": 1000, "b": 800, "none": 0}
    assert plan({}, targets)[0]["budget"] == 0 and plan({"a": 5}, []) == []


def test_mix_against_a_sequential_restatement(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(["word"] * rnd.randint(1, 40)), rnd.choice([" Big", "big", "BIG "]) if k % 10 else rnd.choice(["Small-one", "small_one"]), "x") for k in range(300)]
    rows += [(500, None, "big", "x"), (501, "", "big", "x"), (502, "word", None, "x"), (503, "word", "  ", "x"), (504, "word", "untargeted", "x"), (None, "word", "big", "x"), (1, rows[1][1], "big", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.4, 6), ("nobody", 0.1, 3)], "source string, target_share double, max_repeats int")
    s = {r.doc_id: r for r in sized(docs).collect()}
    assert set(s) == set(range(300)) | {504}
    sizes = {}
    for r in s.values():
        sizes[r.source] = sizes.get(r.source, 0) + r.tokens
    want = {}
    for p in plan(sizes, [("big", 0.5, 1), ("nobody", 0.1, 3), ("small_one", 0.4, 6)]):
        run = 0
        for r in sorted((r for r in s.values() if r.source == p["source"]), key=lambda r: (r.key, r.doc_id)):
            run += r.tokens
            n = p["epochs"] + (run <= p["rest"])
            if n:
                want[r.doc_id] = n
    assert {r.doc_id: r.repeats for r in mix(docs, targets).collect()} == want
    told = {r.source: r for r in shares(docs, targets).collect()}
    assert told["nobody"].mixed_tokens == 0 and abs(told["big"].reached_share - 5 / 9) < 0.02 and told["small_one"].most_repeats <= 6
    assert mix(docs.limit(0), targets).count() == 0 and mix(docs, targets.limit(0)).count() == 0


def test_tokens_and_sources(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    text = "Naïve <|endoftext|> text, 12 rows"
    got = sized(spark.createDataFrame([(1, text, "Design note", "x")], DOCS)).first()
    assert got.tokens == len(t.encode(text, add_special_tokens=False).ids) and got.source == "design_note"
    c = spark.createDataFrame([("Issue-Thread ",), ("_a__b_",), (" - ",)], "s string").select(canonical_source("s").alias("s"))
    assert [r.s for r in c.collect()] == ["issue_thread", "a_b", None]


def test_counts_by_pieces_are_the_tokenizers(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    with open(TOKENIZER, "rb") as f:
        held = f.read()
    t = tokenizers.Tokenizer.from_buffer(held)
    t.encode_special_tokens = True
    rnd = random.Random(4)
    signs = [*map(chr, range(128)), *"  \n\n\t'stmdrevel  aZ09" * 4]
    texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 40))) for _ in range(3000)] + ["", "don't I'LL we'll 'sx", "a <|endoftext|>b", "Naïve  中 x", "　 x", "abc" * 9000, " " * 9000 + "\n x"]
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert by_pieces(held) and TokenCounter(held, False).count(texts) == want
    for chunk, kept, few in ((1 << 18, 200_000, 0), (50, 200_000, 0), (500, 60, 0), (500, 200_000, 20), (1, 5, 3)):
        for name, value in (("CHUNK", chunk), ("KEPT", kept), ("FEW", few)):
            monkeypatch.setattr(mixing, name, value)
        counter = TokenCounter(held, True)
        assert counter.count(texts) == want and counter.count(texts[::-1]) == want[::-1] and counter.count([]) == []
    told = json.loads(held)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"added_tokens": [{"id": 0, "content": "ab", "special": False}]}, {"truncation": {"max_length": 8}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        assert not by_pieces(json.dumps(told | change).encode())


def test_known_pieces_are_not_tokenized_again():
    pytest.importorskip("tokenizers")
    with open(TOKENIZER, "rb") as f:
        counter = TokenCounter(f.read(), True)
    texts = [PROSE * 40] * 20
    want, counter.tokenizer = counter.count(texts), None
    assert counter.count(texts) == want and len(counter.known) < 60


def test_long_pieces_are_not_kept():
    pytest.importorskip("tokenizers")
    with open(TOKENIZER, "rb") as f:
        counter = TokenCounter(f.read(), True)
    texts = [f"{PROSE} {c * 5000} {PROSE}" for c in "abc"]
    want = counter.encoded(texts)
    assert counter.count(texts) == want == counter.count(texts) and max(map(len, counter.known)) <= mixing.LONG
