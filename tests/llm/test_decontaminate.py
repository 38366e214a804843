"""Benchmark items among variants of themselves, with repeated windows, and with other names and units."""

from textloom.llm import decontaminate

TRAIN = "a train leaves with 12 cars and travels 300 km before it stops for fuel in the town"
VARIANT = "a train leaves with 45 cars and travels 810 km before it stops for fuel in the town"
OTHER = "a train leaves with 7 cars and travels 95 km before it stops for fuel in the town"


def flagged(spark, item, texts):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.flag_documents(docs, bench).collect()}
    return [got[i] for i in range(len(texts))]


def test_item_among_its_variants(spark):
    assert flagged(spark, TRAIN, [TRAIN, f"{TRAIN}. {VARIANT}", f"{VARIANT}. {OTHER}", f"{OTHER}, then {TRAIN} and {VARIANT}"]) == [True] * 4
    long = TRAIN + " and the driver looks at the clock while people wait with bags and coats on the old platform by the river until the guard opens all of the doors and calls out where this one goes"
    assert flagged(spark, long, [" ".join(x.replace("and the driver", "and so the driver") for x in (long, long.replace("12", "45").replace("300", "810")))]) == [True]


def test_shuffled_values_are_not_an_item(spark):
    item = "first 5 then 5 then 5 then 5 then 9 then 9 then 9 then 9 are written on the board"
    assert flagged(spark, item, [item, item.replace("9", "4"), "first 1 then 2 then 3 then 4 then 5 then 6 then 7 then 8 are written on the board"]) == [True, True, False]
    far = "on the old board behind the desk in a room at the end of the floor one can read that "
    assert flagged(spark, far + item, [far + item, far + "first 1 then 2 then 3 then 4 then 5 then 6 then 7 then 8 are written on the board"]) == [True, False]


def test_item_that_repeats_its_windows(spark):
    series = "Find the next number in the series 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024 and explain the rule."
    assert flagged(spark, series, [series, f"As before. {series} And again: {series.replace('2, 4', '3, 9')}"]) == [True, True]
    table = "row " + " and ".join(f"{i} then {i * i}" for i in range(3, 30)) + " end"
    assert flagged(spark, table, [table, table.replace("3 then 9", "4 then 4")]) == [True, True]


def test_names_that_open_sentences_and_joined_units(spark):
    item = "Tom has 12 apples. Anna has 3 times as many apples as Tom and gives half of them to a friend"
    other = item.replace("Tom", "Bob").replace("Anna", "Mary").replace("12", "40")
    assert flagged(spark, item, [other, item.lower(), item, f"sheet: {item}", item.upper()]) == [True] * 5
    item = "the bag of rice of 5kg is carried up the hill by two men who take turns until they come to the village square"
    assert flagged(spark, item, [item.replace("5kg", "8kg"), item.replace("5kg", "8 kg"), "T" + item[1:], item]) == [True] * 4
    assert flagged(spark, "the short item has just eight words here", ["The short item has just eight words here"]) == [True]


QUESTIONS = [
    "{n} has {a} {u} of rice and sells {b} {u} of it to {m} on the way home. How many {u} are left in the end?",
    "A car drives {a} {u} in the first hour and {b} {u} in the next. What is the average of the two, and how far has {n} come?",
    "{n} reads {a} pages of the old book each evening for {b} days, and {m} reads half as many. How many pages did both of them read?",
    "The tank of the farm holds {a} {u} of water. {n} takes out {b} {u} each morning until nothing is left. After how many mornings is it empty?",
    "If {n} walks {a}{s} before lunch and {b}{s} after it, while {m} stays in the tent, how long is the whole walk of the day?",
    "There are {a} birds on the roof and {b} birds in the tree. When {n} claps, half of those on the roof fly to the tree. How many sit in the tree now?",
    "In a class of {a} pupils, {b} of them play the flute and {n} alone plays the drum. What part of the class plays no instrument at all?",
    "{n} and {m} share {a} {u} of flour so that one of them gets {b} {u} more than the other. How much flour does each of them get?",
]


def variants(seed):
    """Questions with values drawn, the same with other values, and with values that do not fit their slots."""
    import random

    rng = random.Random(seed)
    names, units, short = "Tom Anna Bob Maria Ivan Chloe Omar Lena".split(), "kilograms miles metres gallons feet litres yards pounds".split(), "kg km m cm ml".split()

    def draw():
        n, m = rng.sample(names, 2)
        return {"n": n, "m": m, "a": rng.randint(20, 99), "b": rng.randint(2, 19), "u": rng.choice(units), "s": rng.choice(short)}

    return [(q.format(**draw()), [q.format(**draw()) for _ in range(6)]) for q in QUESTIONS]


def test_recall_of_questions_with_other_values(spark, monkeypatch):
    """At least nine in ten of 48 variants among other words, also by the shuffled joins; no text that shares a few words."""
    made = variants(1)
    bench = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(made)], "item_id long, text string")
    around = "Some words of another page that has nothing to do with it stand here, and then comes this. "
    docs = [(i * 10 + k, f"{around}{v} {around}", i) for i, (_, vs) in enumerate(made) for k, v in enumerate(vs)]
    clean = [(1000 + i, around + " ".join(q.split()[: len(q.split()) // 2]) + " and then the page goes on with words of its own that no question holds.") for i, (q, _) in enumerate(made)]
    df = spark.createDataFrame([d[:2] for d in docs] + clean + [(1, None), (None, made[0][0]), (docs[0][0], docs[0][1])], "doc_id long, text string")
    for limit in (None, 0):
        if limit is not None:
            monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
            monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", limit)
        got = {(r.doc_id, x) for r in decontaminate.flag_documents(df, bench).collect() for x in r.item_ids}
        assert sum((d, i) in got for d, _, i in docs) >= 0.9 * len(docs)
        assert not {d for d, _ in got} & {d for d, _ in clean} and all(d is not None for d, _ in got)
        assert all(i == next(x[2] for x in docs if x[0] == d) for d, i in got)


def test_texts_of_a_form_with_shuffled_values_are_left_alone(spark):
    """Each mention of a slot has another value: the form is there, the question is not."""
    item = "{0} gave {1} {3} of corn to {2}, then {2} gave {4} {3} of corn back to {0}, and {0} gave {1} {3} of corn to {2} once more, so {2} gave {4} {3} of corn to {0}"
    whole = item.format("Tom", 12, "Anna", "miles", 7)
    other = item.format("Omar", 30, "Lena", "yards", 4)
    shuffled = "Bob gave 3 miles of corn to Anna, then Maria gave 8 feet of corn back to Ivan, and Chloe gave 5 yards of corn to Omar once more, so Lena gave 9 cups of corn to Tom"
    assert flagged(spark, whole, [whole, other, shuffled]) == [True, True, False]


def test_windows_without_wording_say_nothing(spark):
    """Numbers, prices, dates and names in a row are no question; the very same row is."""
    row = " ".join(map(str, range(1, 41)))
    others = [" ".join(map(str, range(107, 607))), " ".join(f"{i},{i}0 kg" for i in range(1, 60)), " ".join(f"{i}.{i % 12 + 1}.1999" for i in range(1, 60)), "Haus Baum Tisch Stuhl Wagen Garten Wald Feld Berg Tal Fluss See Meer Insel Stadt Dorf"]
    assert flagged(spark, row, [row, f"so: {row}.", *others]) == [True, True, False, False, False, False]
    names = "Anna Berta Clara Dora Emma Frieda Greta Hanna Ida Julia Klara Lena"
    assert flagged(spark, names, [names, others[3], row]) == [True, False, False]
    mixed = "which of these numbers does not belong to the row " + " ".join(str(i * i) for i in range(1, 20))
    assert flagged(spark, mixed, [mixed, mixed.replace("16 25", "17 26"), *others]) == [True, True, False, False, False, False]
    assert flagged(spark, "42", ["42", "it is 42 of them", "it is 43", "142 of them"]) == [True, True, False, False]
