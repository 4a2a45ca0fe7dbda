"""The operators of the llm subpackage against brute force, round trips and held-out labels."""

import base64
import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from fairlead.llm import bpe, html_extract, jaccard_join, lm_score, media, packing, pii, quality_classifier, quality_rules, queries, warc  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGES = [None, "", " \t\n", "a", "a", "a b", "one two three", "x " * 3000, "É" * 700, "<|endoftext|>x", "tie\ntie\ntie"]


def frame(spark, texts, first=0):
    rows = [(first + i, t, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, kept string")  # with clashing names


@pytest.fixture(scope="module")
def hf():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_bpe_equals_the_library(hf):
    random.seed(3)
    pool = [chr(c) for c in (*range(0x250), *range(0x300, 0x530), *range(0x2000, 0x2070), 0x1E9E, 0x3000, 0x1F600, 0x4E2D, 0xAC00, 0x1100, 0x1161, 0x966, 0x1C, 0xFEFF, 0xFB01)]
    own = bpe.Tokenizer(PATH)
    for k in range(1500):
        text = "".join(random.choice(pool if random.random() < 0.5 else "aaa bbthe'sll  'ReVE12\n") for _ in range(random.randint(0, 40)))
        text = text + "<|endoftext|>" + text if k % 9 == 0 else "ab" * k if k % 50 == 0 else text
        want = hf.encode(text, add_special_tokens=False).ids
        ids, _ = own.encode([text])
        assert ids.tolist() == want and own.decode(ids) == hf.decode(want, skip_special_tokens=False)


def test_op1(spark, small, docs, hf):
    for r in queries.op1_bpe(spark, small).collect():
        ids = hf.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(hf.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(spark, hf):
    rows = bpe.decode(bpe.encode(frame(spark, EDGES), PATH), PATH).collect()
    assert [r["ids"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [hf.encode(t or "", add_special_tokens=False).ids for t in EDGES]
    assert bpe.encode(frame(spark, []), PATH).isEmpty()


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_op2_measures_and_verdict(spark, small, docs):
    rows = queries.op2_quality_rules(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = measures(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    right = [r["kept"] == (labels[r["doc_id"]] == 1) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(right) >= 0.95 * len(right)


def test_rules_edges(spark):
    found = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, EDGES)).collect()}
    assert len(found) == len(EDGES)
    for i, t in enumerate(EDGES):
        assert (found[i]["n_words"], found[i]["word_chars"], found[i]["n_symbols"], found[i]["n_dup_lines"], found[i]["n_repeat_words"]) == measures(t)
    assert quality_rules.judge(frame(spark, [])).isEmpty()
    plan = quality_rules.measures(frame(spark, EDGES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_verdicts(votes, steps=25):
    """Posterior probabilities of rows of votes (1, 0 or None) by expectation-maximisation over the rows."""
    k = {0: 0, 1: 1, None: 2}
    x = np.array([[k[v] for v in row] for row in votes])
    n, m = x.shape
    prior, good, bad = 0.85, np.tile([0.02, 0.78, 0.20], (m, 1)), np.tile([0.30, 0.60, 0.10], (m, 1))

    def posterior():
        ratio = np.log(good / bad)
        ratio[:, 0], ratio[:, 1], ratio[:, 2] = np.minimum(ratio[:, 0], 0), np.maximum(ratio[:, 1], 0), 0
        return 1 / (1 + np.exp(-(ratio[np.arange(m), x].sum(1) + math.log(prior / (1 - prior)))))

    for _ in range(steps):
        p = posterior()
        old = [prior, good.copy(), bad.copy()]
        prior = min(0.98, max(0.5, p.mean()))
        for table, w, was in ((good, p, old[1]), (bad, 1 - p, old[2])):
            for v in (0, 1):
                table[:, v] = np.clip((((x == v) * w[:, None]).sum(0) + was[:, v]) / (w.sum() + 1), 0.002, 0.98)
            table[:, 2] = np.maximum(0.002, 1 - table[:, 0] - table[:, 1])
        if max(abs(prior - old[0]), np.abs(good - old[1]).max(), np.abs(bad - old[2]).max()) < 1e-3:
            break
    return posterior()


def test_verdicts_equal_a_plain_version(spark, small):
    rows = quality_rules.judge(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")).collect()
    want = plain_verdicts([[r[f"vote_{name}"] for name, _, _ in quality_rules.RULES] for r in rows])
    assert np.allclose([r["quality_probability"] for r in rows], want, atol=1e-6)
    assert [r["kept"] for r in rows] == [not r["base_failed"] and p >= 0.5 for r, p in zip(rows, want)]


def test_scores_equal_a_plain_version(spark, small, docs):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    model = quality_classifier.train(df, spark.read.parquet(f"{small}/labels.parquet"))
    for r in quality_classifier.classify(df, model).collect():
        z = np.clip((quality_classifier.features(docs[r["doc_id"]]) - model.mean) * model.scale, -6, 6)
        margin = sum(math.tanh(float((z * model.hidden[:, j]).sum() + model.bias[j])) * float(model.out[j]) for j in range(len(model.out))) + model.shift
        want = 1 / (1 + math.exp(-max(-30, min(30, (margin - model.centre) * model.slope))))
        assert abs(r["score"] - want) < 1e-3 and r["predicted"] == (r["score"] >= 0.3)


def test_best_region_equals_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        x = [rng.choice([-3.0, -1.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 25))]
        sums = {(a, b): sum(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1)}
        best = max(sums.values(), default=0)
        a, b = html_extract.best_region(x)
        assert abs(sum(x[a:b]) - max(best, 0)) < 1e-9
        capped = html_extract.bounded([100 * v for v in x])
        assert len(capped) == len(x) and all((c == 100 * v) or v < 0 for c, v in zip(capped, x))


def test_tiers_hold_what_they_say(spark, small):
    rows = packing.pack(spark.read.parquet(f"{small}/documents.parquet"), PATH).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for pieces in by.values():
        assert len({p["tier"] for p in pieces}) == 1 and sum(p["length"] for p in pieces) == pieces[0]["tier"]


def check_packing(rows, want):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == want.keys()
    for d, pieces in by_doc.items():
        at, ids = 0, want[d]
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    tokens = padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        tokens, padding = tokens + at, padding + (0 if at & (at - 1) == 0 else 2048 - at)
    return tokens, padding


def test_op3(spark, small, docs, hf):
    want = {d: [*hf.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs.items()}
    tokens, padding = check_packing(queries.op3_packing(spark, small).collect(), want)
    assert padding < 0.01 * tokens


def test_steps_are_balanced_over_the_table(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").repartition(4, "doc_id")
    rows = packing.pack(df, PATH, step_tokens=8192).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["tier"], r["step_group"], r["sequence_id"]] += r["length"]
    assert len({s >> packing.TASK_BITS for _, _, s in sizes}) == 4
    for tier in packing.TIERS:
        steps = collections.Counter(g for t, g, _ in sizes if t == tier)
        last = max(steps, default=0)
        assert sorted(steps) == list(range(last + 1)) and all(n == 8192 // tier for g, n in steps.items() if g < last)
    assert all(n == t for (t, _, _), n in sizes.items())
    short = collections.Counter(s >> packing.TASK_BITS for t, _, s in sizes if t not in packing.TIERS)
    assert all(n <= 8 for n in short.values())
    few = packing.pack(df.coalesce(1), PATH, pool_tokens=3000).collect()  # many pools carry their rest over
    assert len({r["sequence_id"] for r in few if r["tier"] not in packing.TIERS}) <= 8
    check = lambda rows: sorted((r["doc_id"], r["start"] + r["length"]) for r in rows if r["start"] + r["length"] == r["doc_tokens"])
    assert check(few) == check(rows)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"], r["tier"], r["step_group"])
    table = packing.written(df, "steps")
    with_ids = packing.pack(table, PATH, with_ids=True, step_tokens=8192).collect()
    assert sorted(map(key, with_ids)) == sorted(map(key, packing.pack(table, PATH, step_tokens=8192).collect()))
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in with_ids)


def test_packing_edges(spark, hf):
    want = {i: [*hf.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(EDGES)}
    check_packing(packing.pack(frame(spark, EDGES), PATH, pool_tokens=500).collect(), want)
    check_packing(packing.pack(frame(spark, EDGES).coalesce(1), PATH, pool_tokens=30).collect(), want)
    assert packing.pack(frame(spark, []), PATH).isEmpty()


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(digits[::-1]))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_on_random_text():
    random.seed(5)
    for _ in range(4000):
        text = "".join(random.choice("a.b-@@+1 (2)3.4.5 06789\né") for _ in range(random.randint(0, 60)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.detect(text)] == base_spans(text), repr(text)


@pytest.mark.parametrize(
    "text, hidden, kind",
    [
        ("write to joe [at] mail [dot] example [dot] com now", "joe [at] mail [dot] example [dot] com", "email"),
        ("write to joe at example dot com now", "joe at example dot com", "email"),
        ("write to jοe@exаmple.com now", "jοe@exаmple.com", "email"),
        ("host one nine two dot one six eight dot zero dot one up", "one nine two dot one six eight dot zero dot one", "ip"),
        ("call ＋１ (555) ０１２-3456 now", "＋１ (555) ０１２-3456", "phone"),
        ("call plus one four one five five five five zero one two three now", "plus one four one five five five five zero one two three", "phone"),
        ("card 4111​1111​1111​1111 ok", "4111​1111​1111​1111", "card"),
    ],
)
def test_deobfuscation_maps_back_to_the_source(text, hidden, kind):
    base, spans = pii.find(text)
    added = [(pii.KINDS[k], text[a:b]) for k, a, b in spans if (k, a, b) not in base]
    assert (kind, hidden) in added


@pytest.mark.parametrize(
    "text, hidden, kind",
    [
        ("host 192 dot 168 dot 1 dot 10 up", "192 dot 168 dot 1 dot 10", "ip"),
        ("host 192 dot 168 dot one dot 1 up", "192 dot 168 dot one dot 1", "ip"),
        ("port 80 192 punto 168 punto 1 punto 10.", "192 punto 168 punto 1 punto 10", "ip"),
        ("host 10[.]0[.]0[.]1 up", "10[.]0[.]0[.]1", "ip"),
        ("host 10 [dot] 0 (dot) 0 [.] 1", "10 [dot] 0 (dot) 0 [.] 1", "ip"),
        ("host 10.0.zero.1 up", "10.0.zero.1", "ip"),
        ("call plus 4 nine 1 five 5 one 2 three 4 now", "plus 4 nine 1 five 5 one 2 three 4", "phone"),
        ("call +4 nine 1 five 5 one 2 three 4 now", "+4 nine 1 five 5 one 2 three 4", "phone"),
        ("call plus 14155550123 now", "plus 14155550123", "phone"),
        ("card 4111 1111 1111 one 1 1 1 ok", "4111 1111 1111 one 1 1 1", "card"),
        ("write to joe at mail point com now", "joe at mail point com", "email"),
        ("escribe a joe arroba mail.es ya", "joe arroba mail.es", "email"),
        ("schreib an joe klammeraffe mail punkt de bitte", "joe klammeraffe mail punkt de", "email"),
    ],
)
def test_mixed_and_defanged_forms(text, hidden, kind):
    base, spans = pii.find(text)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in spans if (k, a, b) not in base] == [(kind, hidden)]


@pytest.mark.parametrize(
    "text, hidden, spans",
    [
        ("write jοe@example.com now", "jοe@example.com", ["jοe@example.com", "e@example.com"]),
        ("write a.b@mail.ex\u00adample.com", "a.b@mail.ex\u00adample.com", ["a.b@mail.ex\u00adample.com", "a.b@mail.ex"]),
        ("mail joe@mail.com and jοe@mail.com", "jοe@mail.com", ["joe@mail.com", "jοe@mail.com", "e@mail.com"]),
    ],
)
def test_wider_spans_stand_beside_base_spans(spark, text, hidden, spans):
    base, found = pii.find(text)
    assert {text[a:b] for _, a, b in found} == set(spans) and set(base) <= set(found)
    clean = pii.redact(spark.createDataFrame([(text,)], "text string")).first()["text"]
    assert hidden not in clean and all(part not in clean for part in ("jο", "ample"))


def disguises(rng):
    """A sentence with one disguised identifier, the place of that and its kind, by disguise."""
    name = "".join(rng.choice("abcdefghkmnprstuvw") for _ in range(rng.randint(3, 9)))
    host, top = "".join(rng.choice("bcdfgklmnprst") for _ in range(rng.randint(3, 9))), rng.choice(["com", "org", "net", "de", "fr", "es"])
    octets = [rng.randint(0, 255) for _ in range(4)]
    number = "".join(str(rng.randint(0, 9)) for _ in range(10))
    card = "".join(str(rng.randint(0, 9)) for _ in range(15))
    card += next(c for c in "0123456789" if pii.luhn(card + c))
    spell = lambda x, words: " ".join(words[int(c)] for c in x)
    english, german = "zero one two three four five six seven eight nine".split(), "null eins zwei drei vier fünf sechs sieben acht neun".split()
    alike = {v: k for k, v in pii.LOOK_ALIKES.items() if v.isalpha()}
    yield "brackets", f"{name} [at] {host} [dot] {top}", "email"
    yield "round", f"{name}(at){host}(dot){top}", "email"
    yield "words", f"{name} at {host} dot {top}", "email"
    yield "spaces", f"{name} @ {host} . {top}", "email"
    yield "references", f"{name}&#64;{host}&#x2e;{top}", "email"
    yield "named references", f"{name}&commat;{host}&period;{top}", "email"
    yield "look-alikes", "".join(alike.get(c, c) for c in name) + f"@{host}.{top}", "email"
    yield "wide", f"{name}＠{host}．{top}", "email"
    yield "invisible", f"{name[:2]}\u200b{name[2:]}@{host}.{top}", "email"
    yield "other words", f"{name} arroba {host} punto {top}", "email"
    yield "spelled ip", " dot ".join(spell(str(o), english) for o in octets), "ip"
    yield "dotted ip", " dot ".join(map(str, octets)), "ip"
    yield "defanged ip", "[.]".join(map(str, octets)), "ip"
    yield "spelled phone", f"plus {spell(number, english)}", "phone"
    yield "german phone", f"plus {spell(number, german)}", "phone"
    yield "wide phone", "+" + number.translate({48 + d: 0xFF10 + d for d in range(10)}), "phone"
    yield "spelled card", spell(card, english), "card"
    yield "invisible card", "\u200b".join(card[i : i + 4] for i in range(0, 16, 4)), "card"


def test_recall_by_disguise():
    rng = random.Random(21)
    seen, caught = collections.Counter(), collections.Counter()
    for _ in range(300):
        for kind_of, hidden, kind in disguises(rng):
            before = rng.choice(["", "Please write to ", "Sie ist: ", "see, "])
            text = before + hidden + rng.choice(["", ", thanks", " now", "\nand more"])
            seen[kind_of] += 1
            caught[kind_of] += any(pii.KINDS[k] == kind and a == len(before) and b == len(before) + len(hidden) for k, a, b in pii.find(text)[1])
    assert len(seen) == 18
    assert {k: caught[k] / seen[k] for k in seen if caught[k] < 0.95 * seen[k]} == {}


def test_numbers_in_prose_are_no_identifiers():
    for text in ("at this point in time", "see 1.2.3. One more", "from 2 to 4, one of 10 (or 12) dots", "we had one, two or 3 of 1000 dot", "arrive at some point then", "rows 12 13 14 plus 15 of [1] and 2 [.] 3", "meet @ noon . Then we go", "AT&T &#8364; 5 &amp; &#10;"):
        assert pii.find(text) == ([], [])


def test_prose_with_at_and_dot_is_no_address():
    subjects, verbs = "we you they people critics".split(), "look aim laugh arrive work stare point meet".split()
    things = "the dot product|polka dot dresses|the dot matrix|a dot plot|some point in time|this point de vue|the point of no return|one dot or two|noon dot something|every point on the line|the punkt|a d0t".split("|")
    for s in subjects:
        for v in verbs:
            for t in things:
                for end in ("", ".", " of two vectors", " and more", " . Then"):
                    text = f"{s} {v} at {t}{end}"
                    assert pii.find(text) == ([], []), text


def test_plain_numbers_do_not_grow_by_articles():
    for text, hidden in (("call +1 (848) 555-1373 Un homme", "+1 (848) 555-1373"), ("card 4111 1111 1111 1111 one more", "4111 1111 1111 1111"), ("host 10.0.0.1 one of them", "10.0.0.1"), ("one 10.0.0.1", "10.0.0.1")):
        base, spans = pii.find(text)
        assert spans == base and [text[a:b] for _, a, b in base] == [hidden]


@pytest.mark.parametrize(
    "text, hidden, kind",
    [
        ("ask joe AT-SIGN mail DOT com", "joe AT-SIGN mail DOT com", "email"),
        ("ask joe at mail d0t com", "joe at mail d0t com", "email"),
        ("ask joe at sign mail dot com", "joe at sign mail dot com", "email"),
        ("call plus one four one five double five five zero one two three now", "plus one four one five double five five zero one two three", "phone"),
        ("host 192 d0t 168 d0t 1 d0t 10 up", "192 d0t 168 d0t 1 d0t 10", "ip"),
        ("card 4 triple one 4111 1111 triple one 1 ok", None, "card"),
    ],
)
def test_further_disguises(text, hidden, kind):
    added = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find(text)[1]]
    assert added == ([(kind, hidden)] if hidden else [])


def test_op4_adds_nothing_to_the_given_documents():
    """None of them disguises an identifier."""
    import pyarrow.parquet

    texts = pyarrow.parquet.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    assert [(t[a:b], k) for t in texts for base, spans in [pii.find(t or "")] for k, a, b in set(spans) - set(base)] == []


def test_op4_leaves_clean_text_alone(spark, small, docs):
    for r in queries.op4_pii(spark, small).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(docs[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"] == want
    for text in ("look at the cat. two or three of the four", "Un deux trois soleil.", "we met at noon dot"):
        assert pii.find(text) == ([], [])


def test_pii_edges(spark):
    found = pii.detect_pii(frame(spark, [*EDGES, "a@b.c", "1" * 5000, "a@" * 3000]))
    assert {len(r["spans"]) for r in found.collect()} == {0, 1}
    assert [r["text"] for r in pii.redact(frame(spark, [None, "mail a@b.c, 1.2.3.4"])).orderBy("doc_id").collect()] == [None, "mail <email>, <ip>"]


def test_op5_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op5_quality_classifier(spark, folder).collect()
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    good, bad = [s for s, _, q in held if q == 1], [s for s, _, q in held if q == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97 and sum(p == q for _, p, q in held) > 0.9 * len(held)


def test_classifier_edges(spark):
    texts = frame(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.train(texts, none) is None
    assert {r["score"] for r in quality_classifier.classify(texts, None).collect()} == {0.5}
    known = spark.createDataFrame([(i, int(i != 3)) for i in range(len(EDGES))], "doc_id long, quality int")
    scored = quality_classifier.classify(texts, quality_classifier.train(texts, known)).collect()
    assert len(scored) == len(EDGES) and all(0 <= r["score"] <= 1 for r in scored)
    assert scored[3]["score"] == scored[4]["score"]


def test_classifier_keeps_an_all_good_input(spark, small, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = [t for d, t in docs.items() if labels.get(d) == 1]
    random.seed(4)
    words = [w for t in good for w in t.split()]
    texts = [" ".join(random.choices(words, k=random.randint(30, 300))) for _ in range(1500)]
    df = frame(spark, texts).select("doc_id", "text")
    known = spark.createDataFrame([(i, 1) for i in range(0, len(texts), 3)], "doc_id long, quality int")
    kept = quality_classifier.classify(df, quality_classifier.train(df, known)).filter("predicted = 1").count()
    assert kept >= 0.99 * len(texts)


def test_calibration_cuts_two_groups_but_not_one():
    rng = np.random.default_rng(1)
    one, two = rng.normal(2, 2, 6000), np.concatenate([rng.normal(-4, 1, 900), rng.normal(4, 1, 5100)])
    model = quality_classifier.Model(np.zeros(1), np.ones(1), np.zeros((1, 1)), np.zeros(1), np.zeros(1), 0.0, 0.85)
    model.margins = lambda x: x
    model.calibrate(one)
    assert (model.centre, model.slope) == (0.0, 1.0)
    model.calibrate(two)
    assert abs(model.centre) < 0.2 and abs((model.scores(two) < 0.3).sum() - 900) <= 9


def brute_components(texts, size, percent):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    for d, s in sets.items():
        shared = collections.Counter(e for x in s for e in index[x] if e < d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_op6_equals_brute_force(spark, small, docs, size, percent):
    texts = dict(docs)
    random.seed(11)
    words = [f"w{i}" for i in range(400)]
    for g in range(6):  # groups of near copies at and around the threshold, one larger than a block
        base = [random.choice(words) for _ in range(60 + 20 * g)]
        for k in range(90 if g == 0 else 12):
            copy = list(base)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = random.choice(words)
            texts[10_000 + 1000 * g + k] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar(df, size=size, percent=percent).collect()}
    assert got == brute_components(texts, size, percent)


def test_jaccard_edges(spark):
    rows = {r["doc_id"]: r for r in jaccard_join.similar(frame(spark, EDGES)).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in rows.items()} == brute_components(dict(enumerate(EDGES)), 3, 90)
    assert jaccard_join.similar(frame(spark, [])).isEmpty()
    again = jaccard_join.similar(frame(spark, ["a b c d"]).union(frame(spark, ["a b c d"])).union(frame(spark, ["a b c d"]).withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert len(again) == 3 and {r["component_id"] for r in again} == {0}


def test_op7_takes_the_article(spark, small):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.op7_html_extract(spark, small).collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>|<[^>]*\Z", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


def test_html_without_article_marks():
    weight = html_extract.weights({})
    page = """<body><div class="menu"><a href=/>Home</a><a href=/a>About us</a></div><div id=cookie-notice>We use cookies a lot here</div><div><h1>Title &amp; more</h1><p>First   words of
     a text <a href=x>with a link</a> in it.<p>Second paragraph has words too.<script>var x = "<p>no</p>"</script></div><div class="comments"><p>I like this text so much</p></div><footer>&copy; us</footer>"""
    assert html_extract.main_text(page, weight) == "Title & more\nFirst words of a text with a link in it.\nSecond paragraph has words too."
    for bad in (None, "", "<", "<p", "<!--", "<script>x", "&", "<a b='>"):
        assert isinstance(html_extract.main_text(bad, weight), str)


def test_html_marks_only_label(spark):
    words = lambda i, n: " ".join(f"w{(i * 31 + k * 7) % 97}" for k in range(n))
    menu = '<nav><ul><li><a href="/a">Some page</a></li><li><a href="/b">Other page</a></li></ul></nav><div class="ad">Buy it now</div><div>Terms of use and all rights of this site</div>'
    cards = "".join(f'<article><h3><a href="/{k}">Next story {k}</a></h3></article>' for k in range(3))

    def page(i, tag, after=""):
        return f'<body>{menu}<{tag} class="sidebar-left"><h1>Title {i}</h1><p>{words(i, 40)}</p><p>{words(i + 1, 3)}</p></{tag}>{after}<div>Imprint and terms of this site</div><footer>Legal</footer>'

    for size in (20, 1500):
        marked = [(i, page(i, "article"), i) for i in range(size)]
        plain = [(size + i, page(i, "div").replace(' class="sidebar-left"', ""), i) for i in range(size // 5)]
        teased = [(2 * size + i, page(i, "article", f"<div>{cards}</div>"), i) for i in range(size // 5)]
        df = spark.createDataFrame([x[:2] for x in (*marked, *plain, *teased)], "page_id long, html string")
        got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
        for d, _, i in (*marked, *plain, *teased):
            assert got[d] == f"Title {i}\n{words(i, 40)}\n{words(i + 1, 3)}", (size, d)


def articles_of(pages):
    import html

    inside = [re.search(r"<article>(.*?)(</article>|\Z)", p, re.S)[1] for p in pages]
    lines = [[" ".join(html.unescape(re.sub(r"<[^>]*>|<[^>]*\Z", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", i)] for i in inside]
    return ["\n".join(x for x in y if x) for y in lines]


def test_the_region_decides(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weight = html_extract.weights(html_extract.counts(table))
    pages = [r["html"] for r in table.select("html").collect()]
    want = articles_of(pages)
    bare = [re.sub(r"<([a-z0-9]+)\s[^>]*>", r"<\1>", p) for p in pages]
    neutral = [re.sub(r"<(/?)(?:nav|header|footer|aside|form|article|main)\b[^>]*>", r"<\1div>", p) for p in bare]
    right = lambda given: sum(html_extract.main_text(p, weight) == t for p, t in zip(given, want))
    assert right(pages) == len(pages) and right(bare) >= 0.9 * len(pages) and right(neutral) >= 0.9 * len(pages)
    monkeypatch.setattr(html_extract, "best_region", lambda scores: (0, len(scores)))
    assert right(pages) < 0.05 * len(pages)


@pytest.mark.parametrize("learned", [False, True])
def test_names_are_features_and_no_filter(spark, learned):
    weight = html_extract.weights(html_extract.counts(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")) if learned else {})
    words = "running words of the text, one after the other, and more of them to come. " * 4
    body = f"<h1>Title</h1><p>{words}</p><p>{words}</p>"
    text = f"Title\n{words.strip()}\n{words.strip()}"
    menu = '<ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul>'
    for name in ('class="social-science"', 'id="toc-wrap"', 'class="content sidebar-left"', 'id="comment-policy-article"'):
        assert html_extract.main_text(f"<body><nav>{menu}</nav><div {name}>{body}</div><footer>&copy; us</footer>", weight) == text
    alert = html_extract.main_text(f'<body><article>{body}<p class="alert-info">{words}</p>{body}</article>', weight)
    assert alert == "\n".join([text, words.strip(), text])
    links = "<ul>" + "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(30)) + "</ul>"
    found = html_extract.main_text(f"<body><article>{body}{links}{body}</article><footer>us</footer>", weight)
    assert found.startswith(text) and found.endswith(text) and "Link 7" in found
    inner = f'<body><article>{body}<aside><p>Read this too, it is a good one</p></aside><div class="ad"><p>Buy now</p></div>{body}</article>'
    assert html_extract.main_text(inner, weight) == f"{text}\n{text}"


def test_an_advert_within_a_paragraph_is_left_out():
    page = "<article><h1>Title</h1><p>" + "words of it " * 20 + '<span class="ad">Buy this now</span> and more words of it.</p></article>'
    assert "Buy" not in html_extract.main_text(page, html_extract.weights({})) and "and more words" in html_extract.main_text(page, html_extract.weights({}))


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<article><p>words of it</article>", "x")], "page_id long, html string, text string")
    assert [(r["text"], r["n_chars"]) for r in html_extract.extract(df).orderBy("page_id").collect()] == [("", 0), ("", 0), ("words of it", 11)]
    assert html_extract.extract(df.filter("false")).isEmpty()


def test_op8(spark, small, docs):
    for r in queries.op8_media(spark, small).collect():
        raw = (docs[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])


@pytest.mark.parametrize("bpp", [1, 3])
def test_png_undoes_all_filters(bpp):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (11, 7 * bpp), dtype=np.uint8)
    rows, kinds = np.empty_like(image), np.array([0, 1, 1, 2, 2, 3, 3, 4, 4, 2, 1])
    for y, kind in enumerate(kinds):
        for x in range(image.shape[1]):
            a = int(image[y, x - bpp]) if x >= bpp else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - bpp]) if y and x >= bpp else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            rows[y, x] = (int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    assert (media.unfilter(kinds, rows, bpp) == image).all()


def test_damaged_png_is_told(spark):
    good = media.png(np.zeros((2, 576), np.uint8))
    for bad in (good[:-5], good[:40] + b"x" + good[41:], b"", b"GIF89a"):
        with pytest.raises(ValueError):
            media.samples(bad)
    row = media.media_features(spark.createDataFrame([(1, bytearray(good[:-5])), (2, None)], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert row[0]["payload_bytes"] is None and row[0]["media_bytes"] == len(good) - 5 and row[1]["media_bytes"] is None


def test_media_edges(spark):
    rows = media.media_features(media.to_media(frame(spark, EDGES))).orderBy("doc_id").collect()
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in EDGES]
    assert rows[0]["payload_sha256"] == hashlib.sha256(b"\xff" * 576).hexdigest() and rows[3]["feature"] == rows[4]["feature"]


def test_op9(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    largest = {}
    for i, h in pages.items():
        largest[h] = max(i, largest.get(h, -1))
    for r in queries.op9_warc(spark, small).collect():
        raw, top = (pages[r["page_id"]] or "").encode(), largest[pages[r["page_id"]]]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top == r["page_id"] else ("revisit", top))


def test_warc_edges(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (2, "u\nv %", "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (5, "u", "é" * 20000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.read_archives(warc.write_archives(warc.with_revisits(df), archive_bytes=3000), with_payload=True).collect()
    told = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"] or 0) for r in found)
    assert told == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (2, "response", 0), (3, "revisit", 4), (4, "response", 0), (5, "response", 0)]
    assert {r["url"] for r in found if r["page_id"] == 2} == {None, "u\nv %"}
    assert [bytes(r["payload"]).decode() for r in found if r["page_id"] == 5] == ["é" * 20000]


def test_short_archives_have_a_dictionary_too():
    for made in ([b"WARC/1.1\r\n" + b"x" * 50], [b"record one of few", b"record two of few"], [bytes(20)] * 40):
        data = warc.archive(made)
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC and list(warc.records(data)) == made


def test_archives_are_stored(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    stored = warc.write_archives(warc.with_revisits(pages.withColumn("payload", F.lit("clash"))))
    again = spark.read.parquet(stored.written_to)
    assert again.columns == ["path", "content"] and warc.read_archives(again).count() == pages.count()
    assert warc.read_archives(warc.write_archives(warc.with_revisits(pages.limit(0)))).isEmpty()


def test_warc_dictionary_and_damage():
    made = [warc.record(i, "u", (f"<html>page {i} " + "words and more words " * 40).encode(), base64.b32encode(hashlib.sha1((f"<html>page {i} " + "words and more words " * 40).encode()).digest()).decode(), None) for i in range(300)]
    data = warc.archive(made)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC and list(warc.records(data)) == made
    assert warc.parse(made[7])[0] == 7
    short = warc.archive(made[:2])
    for cut in range(1, len(short)):  # wherever an archive is cut off, it is told, or ends with a whole record
        try:
            assert list(warc.records(short[:-cut])) in ([], made[:1])
        except ValueError as error:
            assert "WARC" in str(error)
        except zstandard.ZstdError:
            assert len(short) - cut < 8 + int.from_bytes(short[4:8], "little")  # within the dictionary
    with pytest.raises(ValueError):
        warc.parse(made[0].replace(b"page 0", b"page X"))
    with pytest.raises(ValueError):
        warc.parse(made[0][:-1])


def test_op10_base_scores(spark, small, docs):
    tokens = {d: [*(t or "").encode().lower().split(), None] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    count = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    rows = queries.op10_lm_score(spark, small).collect()
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert abs(r["base_score"] - sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6 * max(1, abs(r["base_score"]))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(count[w] > 0 for w in ws), n, held[r["doc_id"]])
        assert r["score"] < 0
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_lm_scores_do_not_depend_on_the_deal_or_the_head(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    a = {r["doc_id"]: r["score"] for r in lm_score.score(df, group="lang").collect()}
    b = {r["doc_id"]: r["score"] for r in lm_score.score(df.repartition(5), group="lang").collect()}
    assert all(abs(a[d] - b[d]) < 1e-3 for d in a)
    few = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in lm_score.score(df, head=500).collect()}
    many = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in lm_score.score(df).collect()}
    assert all(abs(few[d][0] - many[d][0]) < 1e-6 * max(1, abs(many[d][0])) and few[d][1] == many[d][1] for d in few)


def small_code(depth, n=40):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    words = np.r_[np.uint64(lm_score.END), rng.integers(1 << 60, 1 << 63, n - 1, dtype=np.uint64)]
    head = pa.table({"word": words.view(np.int64), "n": np.sort(rng.integers(2, 400, n))[::-1], "group": [["en", "de", None][i % 3] for i in range(n)]})
    code = lm_score.Code(head, int(head.column("n").to_numpy().sum()) + 30, n + 20, depth)
    return code, words, rng.integers(-90, 90, (lm_score.COUNTED, 1 << 12)).astype(np.int8)


@pytest.mark.parametrize("depth", [2, 6, None])
def test_lm_continuations_sum_to_one(depth):
    code, words, tables = small_code(depth)
    for before in ([], [3], [3, 9], [2, 2, 7, 2, 2, 7]):
        ends = [*words, np.uint64(12345)]  # the last is rare
        texts = [[*(words[i] for i in before), w] for w in ends]
        cost, ids = lm_score.token_costs(code, tables, np.array([w for t in texts for w in t], np.uint64), np.full(len(texts), len(before) + 1))
        assert ids[-1] == code.rare and abs(sum(10 ** cost[len(before) :: len(before) + 1]) - 1) < 1e-4


def plain_cost(code, tables, words):
    """log10 probability of one text, bit by bit in plain Python."""
    from fairlead.llm.lm_score import CELLS, COUNTED, FIRST_STEP, LEVELS, LONGEST_STEP, OWN_BITS, PLACES, RATE, REFINE_RATE, SCALE, START_WEIGHT

    squash = lambda x: 1 / (1 + math.exp(-x))
    weights = collections.defaultdict(lambda: [START_WEIGHT] * (COUNTED + 1))
    table = collections.defaultdict(lambda: [squash((i - CELLS // 2) / 2) for i in range(CELLS)])
    own = collections.defaultdict(lambda: [0, 0])
    index = {int(w): i for i, w in enumerate(code.words[:-1])}
    ids = [index.get(int(w), code.rare) for w in words]
    _, bits = lm_score.bits_of(code, np.array(words, np.uint64), np.array([len(words)]))
    slots = [lm_score.slots_of(bits, k, tables.shape[1].bit_length() - 1) for k in range(COUNTED)]
    total, at, end, waiting = 0.0, 0, FIRST_STEP, []
    for t, i in enumerate(ids):
        place = min(int(math.log2(t + 1)), 15)
        for level in range(code.lengths[i]):
            bit, node = code.codes[i] >> level & 1, int(code.codes[i] & ((1 << level) - 1) | 1 << level)
            gate = (min(level, LEVELS - 1), min(place // 3, PLACES - 1))
            zero, one = own[node]
            x = [tables[k][slots[k][at]] / SCALE for k in range(COUNTED)] + [math.log((one + 0.4) / (zero + 0.4)) if node < 1 << OWN_BITS else 0.0]
            score = sum(a * b for a, b in zip(weights[gate], x))
            p = min(max(squash(score), 0.0005), 0.9995)
            cell = min(max(round(score * 2), -(CELLS // 2)), CELLS // 2) + CELLS // 2
            mixed = min(max(0.75 * p + 0.25 * table[gate[0]][cell], 0.0005), 0.9995)
            total += math.log10(mixed if bit else 1 - mixed)
            waiting.append((gate, cell, node, bit, x, bit - p, bit - table[gate[0]][cell]))
            at += 1
            if at == end:
                seen, hits = collections.Counter(w[0] for w in waiting), collections.Counter((w[0][0], w[1]) for w in waiting)
                for g, c, n, b, inputs, error, off in waiting:
                    for j in range(len(inputs)):
                        weights[g][j] += RATE / math.sqrt(1 + seen[g]) * error * inputs[j]
                    table[g[0]][c] += off * REFINE_RATE / (1 + REFINE_RATE * hits[g[0], c])
                    own[n][b] += 1
                waiting, end = [], end + min(end, LONGEST_STEP)
        total += code.inside[i]
    return total


@pytest.mark.parametrize("depth", [3, 6, None])
def test_lm_score_equals_a_plain_version(depth):
    code, words, tables = small_code(depth)
    random.seed(9)
    texts = [[random.choice([*words, np.uint64(77), np.uint64(78)]) for _ in range(n)] for n in (1, 2, 30, 400, 1500)]
    cost, _ = lm_score.token_costs(code, tables, np.array([w for t in texts for w in t], np.uint64), np.array([len(t) for t in texts]))
    sums = np.add.reduceat(cost, np.cumsum([0, *(len(t) for t in texts[:-1])]))
    assert all(abs(a - plain_cost(code, tables, t)) < 1e-4 * abs(a) + 1e-4 for a, t in zip(sums, texts))


def test_lm_mixes_all_bits_of_a_word():
    """Mixed bits alone tell all head words apart: nothing is left that their counts would have to say."""
    code, words, _ = small_code(lm_score.DEPTH, 1000)
    assert abs(code.inside).max() < 1e-9
    assert len(set(zip(code.codes.tolist(), code.lengths.tolist()))) == len(words) + 1
    _, bits = lm_score.bits_of(code, words, np.array([len(words)]))
    assert (np.bincount(bits.token, minlength=len(words)) == code.lengths[:-1]).all()


@pytest.mark.parametrize("deep", [False, True])
def test_lm_bits_of_a_token_lie_side_by_side(deep):
    """The bits of a token fall into one line of a table for every NEAR of them, each into a slot of its own; a path of
    more than 30 bits is kept whole, a shorter one in narrow numbers."""
    import pyarrow as pa

    code, words, _ = small_code(None, 1000)
    if deep:
        words = np.arange(1, 46, dtype=np.uint64) << np.uint64(40)
        head = pa.table({"word": words.view(np.int64), "n": [1 << 45 - i for i in range(45)], "group": pa.nulls(45, pa.string())})
        code = lm_score.Code(head, (1 << 46) - 2, 45, None)
    assert (code.lengths.max() > 31) == deep
    ids, bits = lm_score.bits_of(code, words, np.array([len(words)]))
    level = np.arange(len(bits.token)) - np.searchsorted(bits.token, bits.token)
    path = code.codes[ids][bits.token]
    assert (bits.bit == path >> level & 1).all() and (bits.node == path & (1 << level) - 1 | 1 << level).all()
    assert bits.node.dtype == (np.int64 if deep else np.int32)
    line = list(zip(bits.token.tolist(), (level // lm_score.NEAR).tolist()))
    for k in range(lm_score.COUNTED):
        slots = lm_score.slots_of(bits, k, 22)
        assert len(set(zip(line, (slots >> lm_score.NEAR).tolist()))) == len(set(line))
        assert len(set(zip(line, slots.tolist()))) == len(slots)


def test_lm_counts_lines_as_it_would_bits():
    """Lines of a length are counted together, whatever their number and whether they are cut short, as bits one by one are;
    a task's counts travel in a byte each, larger ones whole."""
    code, words, _ = small_code(None, 1000)
    text = np.random.default_rng(5).choice(words, 3000)
    sizes = np.array([1, 999, 2000])
    sums, plain = np.zeros((lm_score.COUNTED, 1 << 12, 2), np.int32), np.zeros((lm_score.COUNTED, 1 << 12, 2), np.int32)
    lm_score.add_counts(sums, lm_score.lines_of(code, text, sizes)[1])
    _, bits = lm_score.bits_of(code, text, sizes)
    for k in range(lm_score.COUNTED):
        np.add.at(plain[k], (lm_score.slots_of(bits, k, 12), bits.bit), 1)
    assert (sums == plain).all()

    import pyarrow as pa

    counts = np.zeros(1 << 17, np.int64)
    counts[::5], counts[::1000], counts[7], counts[8], counts[9] = 3, 254, 255, 256, 1 << 40
    data, back = lm_score.packed(counts), np.ones(1 << 17, np.int64)
    lm_score.add_packed(back, pa.py_buffer(data))
    lm_score.add_packed(back, pa.py_buffer(lm_score.packed(np.zeros(1 << 17, np.int32))))
    assert (back == counts + 1).all() and len(data) < 20_000


def test_lm_steps_go_through_each_bit_once_and_in_order():
    """Each text's bits come step by step, the texts with bits left side by side, the longest first."""
    sizes = np.array([0, 5, 16, 3000, 17, 0, 1024, 40])
    ranks, at, steps = lm_score.stepwise(sizes)
    assert sorted(at.tolist()) == list(range(sizes.sum())) and [s[1] for s in steps] == [0, *(s[2] for s in steps[:-1])]
    text, begins, done = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes, 0
    for m, start, end in steps:
        step = min(max(done, lm_score.FIRST_STEP), lm_score.LONGEST_STEP)
        own, place = text[at[start:end]], at[start:end] - begins[text[at[start:end]]]
        assert (ranks[own] == np.sort(ranks[own])).all() and set(ranks[own].tolist()) == set(range(m))
        assert all((place[own == t] == np.arange(done, min(done + step, sizes[t]))).all() for t in set(own.tolist()))
        done += step
    assert done >= 3000 and len(lm_score.stepwise(sizes[:0])[1]) == 0


def test_lm_head_is_filled_from_a_bucket_that_does_not_fit(spark):
    counts = spark.createDataFrame([(0, 5000, None), *((i * 7919 + 1, 3, None) for i in range(1000))], "word long, n long, group string")
    head = lm_score.head_words(counts, 500)
    assert 430 <= head.num_rows <= 500 and head.column("n").to_pylist()[:2] == [5000, 3]
    assert lm_score.head_words(counts, 2000).num_rows == 1001


def test_lm_edges(spark):
    rows = lm_score.score(frame(spark, EDGES)).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == [len((t or "").split()) + 1 for t in EDGES]
    assert lm_score.score(frame(spark, [])).isEmpty()
    assert lm_score.score(frame(spark, ["a b"]).withColumn("doc_id", F.lit(None).cast("long"))).first()["train_tokens"] == 0


def test_near_copies_keeps_one_of_each_group(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "en"), (2, a, "en"), (2, b, "en"), (2, b, "fr"), (3, a + " x", "en"), (None, b, "en"), (None, "c d e f g h", "en"), (4, None, "en"), (4, None, "en"), (5, "", "en"), (5, "", "de"), (1, a, "en")]
    df = spark.createDataFrame([(d, t, x, "s", 1, "mine", 8) for d, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, copy string, _id int")
    kept = pipeline.near_copies(spark, df, small)
    assert kept.schema == df.schema and {(r["copy"], r["_id"]) for r in kept.collect()} == {("mine", 8)}
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept.collect()) == [(0, "c d e f g h"), (1, a), (2, b), (4, ""), (4, ""), (5, ""), (5, "")]
    assert pipeline.near_copies(spark, df.limit(0), small).isEmpty()


def test_stages_keep_columns_with_clashing_names(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    extra = {"n_words": -7, "kept": "mine", "score": -1.5, "predicted": "x", "base_failed": 3, "component": 4, "spans": "s", "row": "r", "key": 5, "id": 6, "vote_length": 7}
    df = spark.read.parquet(f"{small}/documents.parquet").limit(60).withColumns({k: F.lit(v) for k, v in extra.items()})
    for _, stage in pipeline.STAGES[:-1]:
        found = stage(spark, df, small)
        assert found.columns == df.columns
        assert {tuple(r) for r in found.select(*extra).distinct().collect()} == {tuple(extra.values())}
    assert pipeline.STAGES[-1][1](spark, df, small).count() > 0


def test_classifier_stage_drops_what_labels_call_bad(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in pipeline.classifier(spark, docs, folder).select("doc_id").collect()}
    bad, good = ([d for d, q in labels.items() if q == x] for x in (0, 1))
    assert sum(d not in kept for d in bad) >= 0.95 * len(bad) and sum(d in kept for d in good) >= 0.99 * len(good)


def test_classifier_fit_holds_one_copy_of_the_samples():
    """The driver holds the samples in 16 bits and once, standardised, in 32; not three times over."""
    rng = np.random.default_rng(3)
    positive, unlabelled = rng.random((2, 3000, quality_classifier.FEATURES)).astype(np.float16)
    tracemalloc.start()
    model = quality_classifier.fit(positive, unlabelled, 0.85, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * 4 * 6000 * quality_classifier.FEATURES
    both = np.concatenate([positive, unlabelled]).astype(np.float32)
    assert np.array_equal(model.mean, both.mean(0)) and np.array_equal(model.scale, 1 / both.std(0))


def test_prior_is_estimated_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(1)
    good = lambda n: rng.normal(1, 1, (n, 12)).astype(np.float32)
    bad = lambda n: rng.normal(-1, 1, (n, 12)).astype(np.float32)
    for share in (0.3, 0.6, 0.9):
        n = round(4000 * share)
        u = np.concatenate([good(n), bad(4000 - n)])
        assert share - 0.03 <= quality_classifier.estimated_prior(good(4000), rng.permutation(u)) <= share + 0.12
    assert quality_classifier.estimated_prior(good(4000), good(4000)) >= 0.97


def test_labels_that_contradict_count_once(spark, small, docs):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    ids = [d for d in sorted(docs) if zlib.crc32(str(d).encode()) % 5]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    once = quality_classifier.train(df, make([(d, 1) for d in ids[:40]]))
    more = quality_classifier.train(df, make([(d, 1) for d in ids[:40]] * 2 + [(d, q) for d in ids[40:60] for q in (0, 1)]))
    assert np.array_equal(once.hidden, more.hidden) and once.shift == more.shift
    assert quality_classifier.train(df, make([(ids[0], 0), (ids[0], 1), (ids[1], 0)])) is None


def test_packing_does_not_depend_on_how_its_input_is_dealt(spark, small, docs, hf):
    want = {d: [*hf.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs.items()}
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(df, PATH, with_ids=True)
    old = spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        for n in ("2", "8"):  # the table is read otherwise after the pieces are made
            spark.conf.set("spark.sql.files.minPartitionNum", n)
            found = rows.collect()
            check_packing(found, want)
            assert all(r["ids"] == want[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in found)
            dealt = packing.pack(df.orderBy(F.rand()), PATH, with_ids=True).collect()
            check_packing(dealt, want)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if old is None else spark.conf.set("spark.sql.files.minPartitionNum", old)


def test_hot_groups_of_copies(spark):
    random.seed(13)
    words = [f"w{i}" for i in range(5000)]
    base = [random.choice(words) for _ in range(120)]
    texts = {}
    for k in range(1300):  # more than a cell; few are similar to each other, nearly all to the original
        copy = list(base)
        for _ in range(k % 4):
            copy[random.randrange(120)] = random.choice(words)
        texts[k] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar(df).collect()}
    assert got == brute_components(texts, 3, 90)


def test_empty_tables_and_repeated_rows(spark):
    none, twice = frame(spark, []), frame(spark, ["a@b.cd one two", "é"]).union(frame(spark, ["a@b.cd one two", "é"]))
    assert pii.detect_pii(none).isEmpty() and pii.redact(none).isEmpty()
    assert media.media_features(media.to_media(none)).isEmpty()
    assert quality_classifier.classify(none, None).isEmpty() and quality_classifier.train(none, spark.createDataFrame([], "doc_id long, quality int")) is None
    for rows in (pii.detect_pii(twice).select("doc_id", "spans"), media.media_features(media.to_media(twice)), quality_rules.judge(twice).select("doc_id", "kept"), lm_score.score(twice)):
        found = [str(r) for r in rows.collect()]
        assert len(found) == 4 and len(set(found)) == 2
    pages = spark.createDataFrame([(1, "u", "<p>one two three</p>", "x")] * 2 + [(2, None, "<p>" + "word " * 200_000, "y")], "page_id long, url string, html string, n_chars string")
    texts = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()]
    assert len(texts) == 3 and len(set(texts)) == 2 and max(t[2] for t in texts) == 999_999


def test_stages_on_edges(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    good = "The one and the other went to the town, and there they met. " * 6
    rows = [(1, good), (1, good), (None, good + "Again they met."), (None, None), (2, None), (3, ""), (4, " \n"), (5, "long " + "word and text, " * 40_000), (6, "Mail me at joe@mail.com, " + good)]
    df = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        found = stage(spark, df, small)
        empty = stage(spark, df.limit(0), small)
        assert empty.isEmpty() and empty.columns == found.columns
        if name == "packing":
            assert sum(r["length"] for r in found.collect() if r["start"] + r["length"] == r["doc_tokens"]) > 0
            continue
        assert found.columns == df.columns
        kept = sorted(((r["doc_id"] or 0), r["text"] or "") for r in found.collect())
        if name == "near copies":
            assert kept.count((1, good)) == 1 and {(0, ""), (2, ""), (3, ""), (4, " \n")} <= set(kept)
        elif name == "quality rules":
            assert not any(not t.strip() for _, t in kept)
        elif name == "personal data":
            assert kept == sorted(((d or 0), (t or "").replace("joe@mail.com", "<email>")) for d, t in rows)


def test_pipeline_stages(spark, small, docs, hf):
    pipeline = pytest.importorskip("corpus_pipeline")
    from fairlead.llm.common import written

    df = spark.read.parquet(f"{small}/documents.parquet")
    kept = {"start": {r["doc_id"]: r["text"] for r in df.collect()}}
    for name, stage in pipeline.STAGES[:-1]:
        df = written(stage(spark, df, small), "stage")
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in df.collect()}
    for d, t in kept["quality rules"].items():
        n = measures(t)
        assert n[0] >= 10 and 100 * n[4] <= 20 * n[0]
    groups = brute_components(kept["quality classifier"], 5, 80)
    assert set(kept["near copies"]) == {d for d, (_, first) in groups.items() if d == first}
    assert kept["personal data"].keys() == kept["near copies"].keys()
    assert not any(base_spans(t) for t in kept["personal data"].values())
    pieces = pipeline.STAGES[-1][1](spark, df, small).collect()
    check_packing(pieces, {d: [*hf.encode(t, add_special_tokens=False).ids, 1] for d, t in kept["personal data"].items()})
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    clean = [d for d in kept["start"] if labels.get(d) == 1 and 100 * measures(kept["start"][d])[4] <= 20 * measures(kept["start"][d])[0] and measures(kept["start"][d])[0] >= 10]
    assert sum(d in kept["quality classifier"] for d in clean) >= 0.97 * len(clean)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, small)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(want.select(*columns).fetchall(), key=key)


def test_context_counts_of_many_bits_equal_a_plain_sum(spark, small):
    """Whatever a task reads: its 32-bit counts go over to 64-bit ones in between."""
    df = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    counts = lm_score.word_counts(df, "text", None)
    total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    code = lm_score.Code(lm_score.head_words(counts, 1000), total, kinds)
    shared = spark.sparkContext.broadcast(code)
    whole, parted = (lm_score.context_tables(df, "text", shared, 12, held) for held in (lm_score.HELD_BITS, 50))
    sums = np.zeros((lm_score.COUNTED, 1 << 12, 2), np.int64)
    for r in df.collect():
        _, bits = lm_score.bits_of(code, *lm_score.tokens_of([r["text"]]))
        for k in range(lm_score.COUNTED):
            np.add.at(sums[k], (lm_score.slots_of(bits, k, 12), bits.bit), 1)
    plain = np.rint(np.clip(lm_score.stretched(sums[..., 0].astype(float), sums[..., 1].astype(float)) * lm_score.SCALE, -127, 127)).astype(np.int8)
    assert (whole == plain).all() and (parted == plain).all()
