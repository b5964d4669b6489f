import itertools
import random
import re

from quern.llm import decontaminate as D

from . import cases


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_passages_equal_a_search_in_plain_words(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    bench = [(i, " ".join(word() for _ in range(rng.randint(15, 50)))) for i in range(20)]
    docs = []
    for i in range(120):
        parts = [word() for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            parts[len(parts) // 2 : 0] = bench[i % 20][1].split()
        docs.append((i, " ".join(parts)))
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(cases.documents(spark, docs), items(spark, bench), D.Settings(block_tokens=300)).collect()}
    assert got == {(i, j) for i, t in docs for j, b in bench if f" {b} " in f" {t} "}


ITEM = "Then Ann has 3 pears and 5 kg of apples, but Ann eats 1 pear and gives 2 apples to Carl before lunch."


def leaks(text):
    s = D.Settings()
    it = D.prepare([1], [ITEM], s)
    return D.leaks([text], it, D._tables(it), D._Codes(), s)


def test_other_parameters_are_found():
    (row,) = leaks(re.sub("Ann", "Bob", ITEM).replace("3", "7").replace("5", "9").replace("Carl", "Eve"))
    assert row[5] >= 3  # slots with another value


def test_inconsistent_parameters_are_not():
    assert not leaks("Then Ann has 3 pears and 5 kg of apples, but Bob eats 1 pear and gives 4 apples to Carl before lunch.".replace("has 3", "has 8").replace("Ann has", "Zoe has")[:70])
    assert not leaks("Nothing of that kind has been said by Ann before lunch.")


PEOPLE = "Then Ann has 3 pears and 5 kg of apples, but Bob eats 1 pear and gives 2 apples to Carl before lunch."


def test_consistency_holds_both_ways():
    """One name or number can't stand for all of an item's; two numbers may coincide."""
    assert found(PEOPLE, PEOPLE.replace("Ann", "Eve").replace("Bob", "Tim").replace("Carl", "Max").replace("3", "8"))
    assert not found(PEOPLE, re.sub("[0-9]", "7", re.sub("Ann|Bob|Carl", "Zoe", PEOPLE)))
    assert not found(PEOPLE, re.sub("Ann|Bob|Carl", "Zoe", PEOPLE))
    assert found(PEOPLE, PEOPLE.replace("3", "7").replace("1", "7"))
    assert not found("The clerk sold 3 pears, 5 plums, 9 figs, 11 nuts, 13 limes and 15 dates to all of them", "The clerk sold 7 pears, 7 plums, 7 figs, 7 nuts, 7 limes and 7 dates to all of them")


def reparameterised(rng, template, names, numbers):
    """A template with its slots filled: one value for each slot name."""
    values = {k: rng.choice(names) for k in "ABC"} | dict(zip("xyz", rng.sample(numbers, 3)))
    while len({values[k] for k in "ABC"}) < 3:
        values |= {k: rng.choice(names) for k in "ABC"}
    return re.sub(r"\{(\w)\}", lambda m: str(values[m.group(1)]), template)


def test_templates_equal_a_comparison_of_all_pairs(spark):
    """Every document holds one template, filled with its own values; a pair leaks if the templates are equal."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))
    templates = []
    for _ in range(12):
        words = [word() for _ in range(26)]
        for at, slot in zip((2, 6, 9, 13, 17, 20, 24), "AxByACz"):
            words.insert(at, "{%s}" % slot)
        templates.append(" ".join(words))
    names = "Eve Tim Max Joe Liz Sid Pam Ned Una Amy Ron Kim Lou Gus".split()
    bench = [(i, reparameterised(rng, t, names, range(10, 99))) for i, t in enumerate(templates)]
    docs = [(i, " ".join(word() for _ in range(i % 40)) + " then " + reparameterised(rng, templates[i % 12], names, range(100, 999)) + " " + word()) for i in range(60)]
    # In these one name stands for all three.
    docs += [(100 + i, "then " + re.sub(r"\{[ABC]\}", "Zoe", re.sub(r"\{([xyz])\}", "7", t))) for i, t in enumerate(templates)]
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(cases.documents(spark, docs), items(spark, bench), D.Settings(block_tokens=200)).collect()}
    assert got == {(i, i % 12) for i in range(60)}


def test_many_blocks_are_few_workers(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    bench = [(i, words(30)) for i in range(20)]
    docs = cases.documents(spark, [(i, words(40)) for i in range(30)] + [(100 + i, f"so {t} it is") for i, t in bench])
    kept = D.without_leaks(docs, items(spark, bench), D.Settings(block_tokens=60))
    assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= D.CHAIN
    assert cases.ids(kept) == list(range(30))


def found(item, text):
    s = D.Settings()
    it = D.prepare([1], [item], s)
    return D.leaks([text], it, D._tables(it), D._Codes(), s)


TOM = "Tom has 12 apples. Tom gives 5 apples to Anna. How many apples does Tom have now?"
SAM = "Sam has 30 apples. Sam gives 9 apples to Lucy. How many apples does Sam have now?"


def test_names_that_open_sentences_are_found():
    assert found(TOM, SAM)
    assert found(TOM, "so " + SAM.replace(". How", ", how"))
    assert found(TOM, TOM.lower().replace("anna", "Anna").replace("does tom", "does Tom"))
    (row,) = found(TOM, TOM)
    assert row[5] == 0
    assert not found(TOM, "Sam has 30 pears. Lucy sells 9 of them. How many are left?")


def test_variants_side_by_side_are_found():
    eve = ITEM.replace("Ann", "Eve").replace("3", "8").replace("5", "6").replace("1", "4").replace("2", "7").replace("Carl", "Tim")
    zoe = ITEM.replace("Ann", "Zoe").replace("3", "11").replace("5", "12").replace("1", "13").replace("2", "14").replace("Carl", "Max")
    item = "The clerk Ann sold 3 pears to Bob for 7 coins and 5 plums to Carl for 9 coins; then Ann gave 2 figs to Dan and 4 nuts to Fay."
    names = [dict(zip(("Ann", "Bob", "Carl", "Dan", "Fay", "3", "7", "5", "9", "2", "4"), x)) for x in (
        ("Eve", "Tim", "Max", "Joe", "Liz", "12", "18", "15", "13", "16", "14"), ("Zoe", "Sid", "Pam", "Ned", "Una", "21", "22", "23", "24", "25", "26"), ("Amy", "Ron", "Kim", "Lou", "Gus", "31", "32", "33", "34", "35", "36"))]
    variants = [re.sub(r"[A-Z][a-z]+|[0-9]+", lambda m, n=n: n.get(m.group(), m.group()), item) for n in names]
    for text in (*variants, *(" ".join(p) for p in itertools.permutations(variants, 2)), " ".join(variants), item + " " + variants[0]):
        assert found(item, text), text
    people = "Eve Tim Max Joe Liz Zoe Sid Pam Ned Una Amy Ron Kim Lou Gus Ivy Jon Sue Leo Ada".split()
    for seed in range(60):
        rng = random.Random(seed)
        before, two = "word " * rng.randint(0, 60), []
        for _ in range(2):
            n = dict(zip(("Ann", "Bob", "Carl", "Dan", "Fay"), rng.sample(people, 5))) | {k: str(rng.randint(10, 99)) for k in "375924"}
            two.append(re.sub(r"[A-Z][a-z]+|[0-9]+", lambda m, n=n: n.get(m.group(), m.group()), item))
        assert found(item, before + " ".join(two)), seed
    assert found(ITEM, eve + " " + zoe) and found(ITEM, zoe + " " + eve) and found(ITEM, ITEM + " " + eve)


def test_items_of_few_words_are_found_as_they_are():
    for item in ("Evaluate 12 + 35 * 7 - 9 / 3 + 14", "Continue 2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31", "Anna, Bob, Carl, Dan, Eve, Fay, Gus, Hal, Ivy, Jon"):
        (row,) = found(item, f"as was said before: {item}; and so on")
        assert row[5] == 0
        assert not found(item, "as was said before: " + re.sub("[0-9]+", "8", item).replace("Anna, Bob", "Zoe, Pam, Sid").replace("Eve, Fay", "Joe, Liz"))
    assert not found("one", "one two")


def test_rows_of_every_kind(spark):
    bench = [(1, cases.sentence(1, 30)), (2, None), (3, ""), (4, "one"), (None, cases.sentence(3, 12)), (1, cases.sentence(1, 30))]
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(cases.documents(spark), items(spark, bench)).collect()}
    assert {(1, 1), (9, 1), (-10, 1), (None, None)} <= got
    assert not {2, 3, 4, 6, 7} & {i for i, _ in got}
    kept = D.without_leaks(cases.documents(spark), items(spark, bench))
    assert kept.columns == cases.documents(spark).columns
    assert {2, 3, 4, 6, 7} <= set(cases.ids(kept)) and not {1, 9, -10} & set(cases.ids(kept))


def test_no_rows(spark):
    assert D.find_leaks(cases.documents(spark, []), items(spark, [(1, ITEM)])).count() == 0
    assert D.find_leaks(cases.documents(spark), items(spark, [])).count() == 0
    assert cases.ids(D.without_leaks(cases.documents(spark), items(spark, []))) == cases.ALL_IDS


def test_many_blocks_find_what_one_does(spark):
    rng = random.Random(7)
    bench = [(i, ITEM.replace("Ann", f"Name{'abcdefghij'[i % 10]}").replace("pears", f"thing{i} stuff").replace("lunch", f"noon {i}")) for i in range(40)]
    docs = [(i, cases.sentence(i, rng.randint(5, 80)) + " " + bench[i % 40][1].replace("3", "8") + " " + cases.sentence(i + 1, 9)) for i in range(60)]
    found = [sorted(map(tuple, D.find_leaks(cases.documents(spark, docs), items(spark, bench), D.Settings(block_tokens=n)).collect()), key=str) for n in (60, 10**6)]
    assert found[0] == found[1] and {(i, i % 40) for i in range(60)} <= {x[:2] for x in found[0]}


def test_a_block_is_small():
    texts = [" ".join(f"w{i * 31 + j} likes Tom. {j} pears" for j in range(60)) for i in range(300)]
    it = D.prepare(list(range(300)), texts, D.Settings())
    bytes_ = it.values.nbytes + sum(x.hashes.nbytes + x.item.nbytes + x.place.nbytes for x in it.by_size.values())
    assert bytes_ < 150 * len(it.values)
