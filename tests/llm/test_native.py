"""Personal data, mixing, chat: against brute force in Python."""
import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from cartflow.llm import chat, mixing, pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in hit.split(".")), "card": 12 <= len(d) <= 19 and luhn(d),
            "phone": 9 <= len(d) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_base_spans_are_those_of_the_plain_patterns(spark, odd_docs, no_docs):
    rng = random.Random(3)
    letters = "ab1.2@+ -()9\n5é😀34"
    texts = ["", "x@y.z a.b@c-d.ef_q@r.s", "1.2.3.4.5.6.7.8 999.1.1.1 0255.001.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 1",
             " +1 (555) 123-4567 +49 30 1234567 +1.", "a@b@c.d"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "doc_id long, text string")
    rows = pii.find(docs, pii.SpanModel()).select("doc_id", pii.spans_text(F.col("base_spans")).alias("b"), pii.spans_text(F.col("spans")).alias("s")).collect()
    assert {r.doc_id: r.b for r in rows} == {i: base_spans(t) for i, t in enumerate(texts)} | {-1: ""}
    assert all(r.b == r.s for r in rows)
    assert pii.find(odd_docs, pii.SpanModel()).count() == odd_docs.count() and pii.find(no_docs, pii.train(no_docs)).count() == 0


def test_long_runs_take_time_in_proportion(spark):
    texts = ["a" * 300_000 + "@", "1" * 300_000, "1 " * 150_000, "1." * 20_000, "+1" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.find(docs, pii.SpanModel()).select(F.sum(F.size("base_spans"))).first()[0] is not None


def test_many_spans_take_time_in_proportion(spark):
    """One text of 1 MB with about 60,000 numbers; steps that look at all spans before them take hours."""
    parts = ["4111 1111 1111 1111", "1.2.3.4", "call +49 30 1234567 now", "555-123-4567", "4111-1111 1111-1112", "12345678 is"]
    text = " ".join(parts[i * i % 7 % 6] for i in range(60_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = pii.SpanModel(trees=[(k, 1.0, (0.9,)) for k in range(4)], thresholds=[0.5] * 4)
    start = time.time()
    row = pii.find(docs, model).select("base_spans", "spans").first()
    clean = pii.redact(docs, model).first().text
    assert time.time() - start < 120
    assert ",".join(f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in row.base_spans) == base_spans(text)
    want, at = [], 0
    for s in row.spans:
        if s.start >= at:
            want += [text[at:s.start], f"[{pii.KINDS[s.kind].upper()}]"]
        at = max(at, s.end)
    assert clean == "".join(want) + text[at:]


def test_running_values_and_halving(spark):
    rng = random.Random(4)
    rows = [([rng.randint(-9, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 7, 8, 9, 100)]
    frame = spark.createDataFrame(rows, "v array<int>")
    for (v,), r in zip(rows, frame.select(pii.running(F.col("v"), lambda a, b: a + b).alias("r")).collect()):
        assert r.r == [sum(v[:i + 1]) for i in range(len(v))]
    spans = frame.select(F.transform(F.array_sort(F.transform("v", lambda x: x + 10)), lambda x: F.struct((x + 0).alias("start"))).alias("s"))
    spans = spans.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(20))))
    for r in spans.select("s", "at", pii.last_before(F.col("s"), F.col("at"))["start"].alias("got")).collect():
        assert r.got == max((x.start for x in r.s if x.start < r.at), default=None)


def test_text_is_cut_by_code_points(spark):
    text = "😀é\n" * 1500 + "end"
    spans = [(0, 2), (1023, 1026), (1026, 1026 + 2048), (len(text) - 1, len(text))]
    frame = spark.createDataFrame([(text, [(*s, f"<{i}>") for i, s in enumerate(spans)])], "t string, s array<struct<start:int,end:int,put:string>>")
    want, at = "", 0
    for i, (a, b) in enumerate(spans):
        want, at = want + text[at:a] + f"<{i}>", b
    assert frame.select(pii.replaced(F.col("t"), F.col("s")).alias("x")).first().x == want + text[at:]


def test_trees_add_what_the_checks_miss_and_redaction_covers_it(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    assert model.trees and all(t is None or t >= 0.5 for t in model.thresholds)
    found = pii.find(docs, model).select("doc_id", "text", "base_spans", "spans").collect()
    assert all(set(r.base_spans) <= set(r.spans) for r in found)
    clean = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    for r in found:
        if not r.spans:
            assert clean[r.doc_id] == r.text
            continue
        want, at = "", 0
        for s in r.spans:
            if s.start >= at:
                want += r.text[at:s.start] + f"[{pii.KINDS[s.kind].upper()}]"
            at = max(at, s.end)
        assert clean[r.doc_id] == want + r.text[at:]


FORMS = {"joe.doe(at)example.com": "email", "joe_d (at) mail.example.org": "email", "jd[at]example[dot]com": "email", "joe at example dot com": "email",
         "(555) 123-4567": "phone", "1 (555) 987-6543": "phone", "555.123.4567": "phone", "555-123-4567": "phone", "4111.1111.1111.1111": "card", "4111/1111/1111/1111": "card",
         "10[.]20[.]30[.]40": "ip"}
# forms that neither the fit nor the calibration writes
FORMS |= {"joe<AT>example[dot]com": "email", "joe.d AT example.co DOT uk": "email", "00491711234567": "phone", "0171/1234567": "phone",
          "4111_1111_1111_1111": "card", "41111 - 11111 - 11111 - 1": "card", "10 . 20 . 30 . 40": "ip"}
LOOK_ALIKES = ["2021-03-14", "14/03/2021", "4111.1111.1111.1112", "meet (at) noon", "me@host", "4111_1111_1111_1112", "300 . 20 . 30 . 40", "look AT that"]


def test_trees_find_forms_that_no_base_pattern_has(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = [(-1 - i, f"words of a text and {form} among other words") for i, form in enumerate([*FORMS, *LOOK_ALIKES])]
    rows.append((-101, "paid with 4465758382889437 4465758382889437 in all"))
    rows.append((-100, "ask joe(at)example.org. The rest"))  # two candidates overlap: the next sentence isn't taken along
    planted = spark.createDataFrame(rows, docs.schema)
    model = pii.train(docs.union(planted))
    found = {r.doc_id: (r.b, r.s) for r in pii.find(planted, model).select(
        "doc_id", pii.spans_text(F.col("base_spans")).alias("b"), pii.spans_text(F.col("spans")).alias("s")).collect()}
    for i, form in enumerate([*FORMS, *LOOK_ALIKES]):
        want = f"{FORMS[form]}:20:{20 + len(form)}" if form in FORMS else ""
        assert found[-1 - i] == ("", want), form
    assert found[-100] == ("", "email:4:22")
    assert set(found[-101][1].split(",")) - {"card:10:26", "card:27:43"} <= {""}  # two numbers are never one span


def test_thresholds_see_all_documents_outside_the_fit(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    seen = []
    counted = pii.calibration
    monkeypatch.setattr(pii, "calibration", lambda docs, model: seen.append(docs.count()) or counted(docs, model))
    total = docs.count()
    pii.train(docs, sample_docs=total // 2)
    assert 0.55 * total < seen[0] < 0.75 * total  # all but 70% of the sampled half


def test_overlapping_candidates_compete(spark):
    rows = [([(-0.9, 0, 5), (-0.95, 4, 9), (-0.99, 8, 12), (-0.5, 20, 21)],), ([(-0.9, 0, 5), (-0.8, 0, 3), (-0.8, 3, 5)],), ([],)]
    frame = spark.createDataFrame(rows, "c array<struct<rank:double,start:int,end:int>>")
    got = [[(w.start, w.end) for w in r.w] for r in frame.select(pii.winners(F.col("c")).alias("w")).collect()]
    assert [sorted(g) for g in got] == [[(0, 5), (8, 12), (20, 21)], [(0, 5)], []]


def brute_mix(docs):
    """Repeated resharing, and the prefix sums of sorted keys."""
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.text or "") for r in docs]
    size = {}
    for _, s, n, _ in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total = {}, sum(size.values())
    free, left = set(order), float(total)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * size[s]}
        if not full:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in full}
        left -= sum(3 * size[s] for s in full)
        free -= full
    taken = []
    for s in order:
        epochs = min(3, math.floor(target[s] / size[s])) if size[s] else 0
        rest = target[s] - epochs * size[s]

        def key(row):
            u = (int(hashlib.md5(f"7:{'null' if row[0] is None else row[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            share = sum(c.isalpha() for c in row[3]) / max(len(row[3]), 1)
            return -math.log(u) / max(0.25, share), -1 if row[0] is None else row[0]
        before = 0
        for row in sorted((r for r in rows if r[1] == s), key=key):
            taken.append((row[0] if row[0] is not None else -1, row[2], size[s], round(target[s], 6),
                          row[2] * epochs + max(0, min(row[2], math.floor(rest + 1e-6) - before))))
            before += row[2]
    return sorted(taken)


def test_mix_is_that_of_the_sorted_keys(spark, odd_docs, no_docs):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for docs in (table, odd_docs):
        rows = mixing.mix(docs).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rows) == brute_mix(docs.collect())
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_mix_comes_within_a_word_of_its_targets(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    long = lambda i, n, source: (i, "word " * n, source)
    one = spark.createDataFrame([long(0, 4000, "b"), *[long(i, 10, "b") for i in range(1, 11)], long(20, 4000, "a")], table.schema)
    two = spark.createDataFrame([long(0, 3000, "a"), long(1, 5100, "b")], table.schema)
    for docs in (table, one, two):
        rows = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
        assert all(abs(r.t - r.want) <= 1 and (r.most or 0) <= 3 for r in rows)
        mixed = mixing.mixed_documents(docs).select("source", mixing.word_count(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
        assert {r.source: r.n for r in mixed if r.n} == {r.source: r.t for r in rows if r.t}
    text = " a\tb  c\n d "
    cut = spark.createDataFrame([(text, n) for n in range(5)], "t string, n int").select(mixing.first_words(F.col("t"), F.col("n")).alias("x")).collect()
    assert [r.x for r in cut] == ["", " a", " a\tb", " a\tb  c", " a\tb  c\n d"]


def told(turns):
    return "".join(f"{r or ''}\n{t}\n" for r, t in turns)


def test_windows_read_back_to_the_conversations(spark):
    rng = random.Random(5)
    parts = ["</s>", "[INST]", "\\", "\\l", "\\e", "<s>user\n", "word ", "é😀", "\n", "z", "[/INST]"]
    rows, want = [], {}
    for conv in range(60):
        turns = []
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "assistant", "system" if turn == 0 else "user", None if rng.random() < 0.1 else "tool\nx"])
            text = rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))])
            rows.append((conv, turn, role, text, "extra"))
            turns.append((role, text or ""))
        want[conv] = turns
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, span string")
    made = chat.windows(frame, budget=40, history=2, history_tokens=20)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    for conv, turns in want.items():
        target = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(told(turns).encode()).hexdigest()
        assert got[conv].loss_chars == len(target) and got[conv].loss_sha256 == hashlib.sha256(target.encode()).hexdigest()
    rows = made.collect()
    assert sum(got[c].formatted_chars for c in want) == sum(len(r.text) for r in rows)
    assert any(r.n_repeated for r in rows) and len(rows) > len(want)
    for r in rows:  # the system turn opens every window, and control strings are the template's only
        first = want[r.conv_id][0]
        if first[0] == "system":
            assert r.text.startswith("<s>system\n")
        assert r.text.count("</s>") == r.text.count("<s>") and "[" not in r.text
    assert chat.windows(frame.limit(0)).count() == 0


def test_history_has_no_hole(spark):
    rows = [(1, 0, "user", "first"), (1, 1, "assistant", "long " * 60), (1, 2, "user", "next " * 60), (1, 3, "user", "short"), (1, 4, "assistant", "end " * 60)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.windows(frame, budget=60, history=2, history_tokens=20).collect():
        shown = [next(i for i, (_, _, _, t) in enumerate(rows) if t in x) for x in r.text.split("</s>")[:-1]]
        assert shown == list(range(shown[0], shown[0] + len(shown)))


def test_windows_of_ties_and_null_ids(spark):
    frame = spark.createDataFrame([(None, 1, "user", "a"), (None, None, "assistant", "b"), (1, 1, "user", "x"), (1, 1, "user", "x")],
                                  "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.digests(chat.windows(frame)).collect()}
    assert got == {None: 2, 1: 2}
