from corpuslake.llm import decontaminate as dc

ITEM = "If Alice buys 12 apples for 3 dollars each day and Alice eats 2 of them, how many apples are left for Bob after 7 days?"


def answer(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "x")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in dc.leaks(d, b).collect()}


def test_finds_verbatim_and_reparameterised_items(spark):
    pad = " ".join(f"w{i}" for i in range(40))
    renamed = ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "35").replace("7", "9")
    mixed = ITEM.replace("Alice", "Carol", 1)
    docs = [(1, f"{pad} {ITEM} {pad}"), (2, f"{pad}\n{renamed} {pad}"), (3, f"{pad} {mixed}"),
            (4, pad), (5, f"{pad} {ITEM[:60]}"), (6, None), (7, ""), (None, ITEM), (8, ITEM), (8, pad), (8, ITEM)]
    got = answer(spark, docs, [(10, ITEM), (11, None), (12, ""), (None, pad)])
    assert set(got) == {(1, 10), (2, 10), (8, 10)}
    assert got[1, 10].verbatim and not got[2, 10].verbatim and got[2, 10].share == 1.0


def test_share_of_windows_like_brute_force(spark):
    base = [f"b{i}" for i in range(30)]
    docs = []
    for k in range(1, 20):
        words = list(base)
        for i in range(0, 30, k):
            words[i] = "zz"
        docs.append((k, " ".join(["lead"] * (k % 3) + words)))
    windows = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {k for k, t in docs if len(windows(base) & windows(t.split())) >= 0.8 * len(windows(base))}
    assert {d for d, _ in answer(spark, docs, [(1, " ".join(base))])} == want


def test_short_items_empty_tables_and_extra_columns(spark):
    assert set(answer(spark, [(1, "a b c"), (2, "a b c d"), (3, "A  b\tc")], [(5, "a b c")])) == {(1, 5), (3, 5)}
    assert answer(spark, [], [(5, "a b c")]) == {} and answer(spark, [(1, "a b c")], []) == {}
    d = spark.createDataFrame([(1, "x y z", 9, 4)], "doc_id long, text string, window long, item_id long")
    b = spark.createDataFrame([(2, "q r s", 1)], "item_id long, text string, doc_id long")
    assert dc.leaks(d, b).count() == 0
    assert dc.without_leaks(d, b).collect() == d.collect()


def test_slots_are_compared_at_each_windows_own_place(spark):
    plain = [f"v{i}" for i in range(60)]
    def item(who, n, more=(), last=None):  # noqa: E306
        w = list(plain)
        w[2], w[5], w[54], w[57] = who, str(n), last or who, str(n)
        for at, word in sorted(more, reverse=True):
            w[at:at] = [word] if word else []
            if not word:
                del w[at]
        return " ".join(w)

    pad = "before it "
    docs = [
        (1, pad + item("Alice", 12, [(30, "extra")])), (2, item("Alice", 12, [(30, None)])),
        (3, item("Carol", 35, [(30, "extra")]) + " after"), (4, pad + item("Carol", 35, [(20, "x"), (40, None)])),
        (5, item("Carol", 35, [(30, "extra")], last="Dave")), (6, item("Alice", 12, last="Dave")),
        (7, item("Carol", 35) + " " + item("Alice", 12)), (8, item("Carol", 35, [(30, "a")]) + " " + item("Erin", 7, [(31, None)])),
        (9, item("Carol", 35, last="Dave") + " between " + item("Erin", 7)),
    ]
    got = answer(spark, docs, [(1, item("Alice", 12))])
    assert {d for d, _ in got} == {1, 2, 3, 4, 7, 8, 9}
    assert {d for (d, _), r in got.items() if r.verbatim} == {7}
    assert all(0.8 <= r.share <= 1 for r in got.values())


def test_blanks_sentence_openings_and_number_words(spark):
    maria = "Maria has 3 apples. Maria buys 4 more apples at the market. How many apples does Maria have now in total?"
    tom = "Tom reads 12 pages of his book before lunch. Sara reads 9 pages of her book after lunch. Who reads more pages today?"
    hours = "A train needs three hours for the way from the old town to the sea and waits there for 20 minutes before it returns."
    docs = [
        (1, maria.replace("Maria", "Anna").replace("3", "5").replace("4", "8")),
        (2, tom.replace("Tom", "Max").replace("Sara", "Ida").replace("12", "30")),
        (3, "lead in text " + hours.replace("three", "four").replace("20 minutes", "15 days")),
        (4, maria.replace(" ", "    ")), (5, maria.replace(" Maria", "    Maria")), (6, "\n\n".join(tom.split())),
        (7, tom.replace("Tom", "Max").replace("before", "after").replace("book", "page").replace("today", "now").replace("lunch", "bed")),
        (8, maria.replace("Maria", "Anna", 1).replace("Maria", "Ida", 1)), (9, "(Maria) " + maria.replace(" 3 ", " (3) ")),
    ]
    got = set(answer(spark, docs, [(1, maria), (2, tom), (3, hours)]))
    assert got == {(1, 1), (2, 2), (3, 3), (4, 1), (5, 1), (6, 2), (9, 1)}


def reworded(rng, names, numbers):
    """A question as a template, with the slots of one filling."""
    verbs = [["buys", "finds", "sells", "paints"], ["gives", "sends", "shows", "lends"], ["keeps", "counts", "packs", "drops"]]
    things = rng.sample(["apples", "marbles", "stamps", "pencils", "shells", "coins", "books"], 2)
    a, b, c = (rng.choice(v) for v in verbs)
    shape = rng.choice([
        "{A} {a} {x} {t} on the way to the harbour and {b} {y} of the {u} to {B} . {A} {c} the rest for {z} days . How many {t} does {A} hold ?",
        "If {A} {a} {x} {t} each morning while {B} only {b} {y} {u} each night , after how many weeks have {A} and {B} reached {z} {t} ?",
        "In a big box there are {x} {t} ; {B} {a} {y} of them , then {A} {b} twice as many {u} and {c} {z} percent of what was left ."])
    shape = shape.format(a=a, b=b, c=c, t=things[0], u=things[1], A="{A}", B="{B}", x="{x}", y="{y}", z="{z}")
    fill = lambda: shape.format(**dict(zip("AB", rng.sample(names, 2))), **dict(zip("xyz", rng.sample(numbers, 3))))
    return fill(), fill()


def test_recall_of_reparameterised_questions(spark):
    import random

    rng = random.Random(4)
    names = ["Alice", "Bob", "Chen", "Dora", "Emil", "Fay", "Gus", "Ivy's", "Jörg"]
    numbers = ["3", "12", "45", "1,200", "7.5", "seven", "twenty", "90", "$15"]
    made = [reworded(rng, names, numbers) for _ in range(120)]
    pad = lambda: " ".join(f"p{rng.randrange(500)}" for _ in range(rng.randrange(0, 60)))
    docs = [(i, f"{pad()} {other} {pad()}") for i, (_, other) in enumerate(made)] + [(1000 + i, pad()) for i in range(50)]
    got = set(answer(spark, docs, [(i, item) for i, (item, _) in enumerate(made)]))
    assert sum((i, i) in got for i in range(120)) >= 0.9 * 120
    assert not [d for d, _ in got if d >= 1000]


def test_no_leak_is_lost_to_the_choice_of_pairs(spark, monkeypatch):
    import random

    rng = random.Random(8)
    vocabulary = ["the", "a", "of", "harbour", "12", "Bob", "km", "Ann", "seven", "sails", "to"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 25])))) for i in range(25)]
    docs = []
    for i in range(150):
        words = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((i, " ".join([rng.choice(["x y", ""]), *words, rng.choice(["z", ""])])))
    got = set(answer(spark, docs, items))
    monkeypatch.setattr(dc, "suspects", lambda docs, pairs, work: docs.select("doc_id", "text_hash").distinct())
    assert got == set(answer(spark, docs, items)) and got


def test_very_long_texts_and_extra_columns(spark):
    long_ = " ".join(f"q{i % 9973}" for i in range(200_000))
    got = answer(spark, [(1, long_ + " " + ITEM), (2, long_), (3, "x" * 500_000)], [(1, ITEM), (2, "y" * 100_000)])
    assert set(got) == {(1, 1)}
