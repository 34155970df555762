import random

from conftest import SMALL
from tidemark.llm import lines

SCHEMA = "doc_id long, text string, owner string, d1 int"


def shingles(line):
    units = line.encode("utf-16-be")
    n = max(len(units) // 2 - lines.SHINGLE, 0)
    return {units[2 * i : 2 * (i + lines.SHINGLE)] for i in range(n + 1)}


def brute(rows):
    """Line dedup by definition: all pairs of lines, one line of each component stays."""
    clean = lambda x: x.strip(" ").lower()
    owner = {}
    for i, text in rows:
        for line in map(clean, (text or "").split("\n")):
            owner[line] = min(owner.get(line, (True, 0)), (i is None, i or 0))
    owner.pop("", None)
    names = sorted(owner)
    sets, root = {x: shingles(x) for x in names}, {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(names):
        for y in names[a + 1 :]:
            both = len(sets[x] & sets[y])
            if both >= lines.ALIKE * (len(sets[x]) + len(sets[y]) - both):
                root[find(x)] = find(y)
    groups = {}
    for x in names:
        groups.setdefault(find(x), []).append(x)
    kept = set()
    ties = {}
    for group in groups.values():
        least = min(owner[x] for x in group)
        ties.update({x: sum(owner[y] == least for y in group) > 1 for x in group})
        kept |= {x for x in group if owner[x] == least}
    return owner, kept, ties


def test_same_as_definition(spark):
    rng = random.Random(6)
    words = [rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + rng.choice("nrst") + rng.choice("aeiou") for _ in range(300)]
    base = [" ".join(rng.choices(words, k=30)) for _ in range(12)]
    rows = []
    for i in range(90):
        text = []
        for _ in range(rng.randrange(1, 5)):
            line = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line[rng.randrange(30)] = rng.choice(words)
            text.append(" ".join(line) if rng.random() < 0.8 else " ".join(rng.choices(words, k=rng.randrange(1, 20))))
        rows.append((i, "\n".join(text)))
    owner, kept, ties = brute(rows)
    docs = spark.createDataFrame([(*r, "o", 1) for r in rows], SCHEMA)
    found = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    left = {}
    for i, text in rows:
        for line in set(text.split("\n")):
            if line in found[i].split("\n"):
                left.setdefault(line, []).append(i)
    assert all(len(v) == 1 and (False, v[0]) == owner[x] for x, v in left.items())
    assert {x for x in left if not ties[x]} == {x for x in kept if not ties[x]}
    assert set(left) <= kept


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    owner, kept, ties = brute(rows)
    found = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    have = [(x.strip(" ").lower(), i) for i, t in found.items() for x in t.split("\n") if x.strip(" ")]
    assert len(have) == len(set(x for x, _ in have)) and all(owner[x] == (False, i) for x, i in have)
    assert {x for x, _ in have if not ties[x]} == {x for x in kept if not ties[x]}


def test_odd_rows(spark):
    rows = [
        (3, "same line here\n\nSame line HERE \nother"), (1, "same line here\n"), (2, None), (4, ""), (None, "other\nonly without id"), (5, "a\na\nb"), (5, "a\na\nb"),
        (6, "same line here"), (7, "x\r\ny"), (8, "z" * 100_000 + "\nshort"), (9, "z" * 100_000),
    ]
    docs = spark.createDataFrame([(*r, "o", 1) for r in rows], SCHEMA)
    result = lines.dedup(docs)
    assert result.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in result.collect()), key=repr) == sorted(
        [
            (3, "\nother"), (1, "same line here\n"), (2, None), (4, ""), (None, "only without id"), (5, "a\nb"), (5, "a\nb"), (6, ""), (7, "x\r\ny"),
            (8, "z" * 100_000 + "\nshort"), (9, ""),
        ],
        key=repr,
    )
    assert lines.dedup(docs.limit(0)).count() == 0


def test_main_path_is_native(spark):
    plan = lines.dedup(spark.createDataFrame([(1, "a b c", "o", 1)], SCHEMA))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_texts_by_join(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    docs = spark.createDataFrame([(1, "some longer line of text here", "o", 1), (2, "some longer line of text here!", "o", 1)], SCHEMA)
    assert {r.doc_id: r.text for r in lines.dedup(docs).collect()} == {1: "some longer line of text here", 2: ""}


def test_few_rounds_settle_a_bucket_of_unlike_lines(spark, monkeypatch):
    """Rows of the first round hold no bitmaps, and the second has many pivots: lines that share a bucket and little else need few rounds."""
    rounds, real = [], lines.durable

    def counted(frame, name):
        rounds.append((name, len(frame.columns)))
        return real(frame, name)

    monkeypatch.setattr(lines, "durable", counted)
    monkeypatch.setattr(lines, "BANDS", [(0,)])
    rng = random.Random(3)
    start = "the same beginning of each line "
    rows = [(i, "".join([start, *rng.choices("abcdefgh", k=20)])) for i in range(60)] + [(100, rows_ := start * 2), (101, rows_ + "!")]
    docs = spark.createDataFrame([(*r, "o", 1) for r in rows], SCHEMA)
    found = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    assert [i for i, text in found.items() if not text] == [101]
    assert sum(name == "ranked-lines" for name, _ in rounds) <= 1
    assert dict(rounds)["line-stars"] == 4


def test_pairs_of_a_crowd_are_made_once_and_bounded_by_exact_sizes(spark, monkeypatch):
    """Lines that share many buckets and are not quite alike make each pair in one bucket only, and repeats within a line don't loosen the bound."""
    made, real = [], lines.durable

    def counted(frame, name):
        found = real(frame, name)
        if name == "line-pairs":
            made.append([frame._jdf.queryExecution().toString().count("array_intersect") > 0, found.count(), found.distinct().count()])
        return found

    monkeypatch.setattr(lines, "durable", counted)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(1000)]
    start = rng.choices(words, k=40)
    crowd = [" ".join(rng.choices(words, k=11) + start + ["la"] * 150) for _ in range(60)]
    docs = spark.createDataFrame([(i, line, "o", 1) for i, line in enumerate(crowd)], SCHEMA)
    owner, kept, _ = brute(list(enumerate(crowd)))
    found = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    assert {x for x in found.values() if x} == kept
    later = made[1:]
    assert later and all(once and rows == different for once, rows, different in later)
    assert sum(rows for _, rows, _ in later) < 60 * 59 // 8
