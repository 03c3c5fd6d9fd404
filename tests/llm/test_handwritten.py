import random
import re

import numpy as np
import pytest

from unitquarry.llm import handwritten as H

WORDS = "anchor basket candle dagger eagle fabric garnet hammer island jacket kettle ladder mallet nectar orbit panel quartz ribbon saddle tabard".split()


def unit(rng, statements=60, name="Hand"):
    """Code of varied structure, as people write it."""

    def w():
        return rng.choice(WORDS).title() + rng.choice(WORDS).title()

    def value(depth=0):
        pick = rng.randrange(11 if depth < 3 else 4)
        if pick < 4:
            return [w(), w(), str(rng.randrange(999)), f"'{rng.choice(WORDS)}'"][pick]
        one, two = value(depth + 1), value(depth + 1)
        return [f"{one} {rng.choice('+-*/')} {two}", f"{w()}({one}, {two})", f"{w()}.{w()}[{one}]", f"({one} {rng.choice(['shl', 'and', 'or', 'xor', 'mod'])} {two})", f"{w()}^.{w()}", f"@{w()}", f"not {one}"][pick - 4]

    def statement(depth=0):
        pick = rng.randrange(10 if depth < 3 else 3)
        inner = lambda: "\n".join(statement(depth + 1) for _ in range(rng.randrange(1, 4)))
        return [
            lambda: f"{w()} := {value()};",
            lambda: f"{w()}({', '.join(value() for _ in range(rng.randrange(1, 4)))});",
            lambda: f"{w()}.{w()} := {value()};",
            lambda: f"if {value()} {rng.choice(['>', '<', '=', '<>'])} {value()} then\nbegin\n{inner()}\nend;",
            lambda: f"for {w()} := {value()} {rng.choice(['to', 'downto'])} {value()} do\n{statement(depth + 1)}",
            lambda: f"try\n{inner()}\nfinally\n{inner()}\nend;",
            lambda: f"case {w()} of\n{rng.randrange(9)}: {statement(depth + 1)}\nelse\n{inner()}\nend;",
            lambda: f"while {value()} do\nbegin\n{inner()}\nend;",
            lambda: f"repeat\n{inner()}\nuntil {value()};",
            lambda: f"with {w()} do\n{statement(depth + 1)}",
        ][pick]()

    return f"unit {name};\n\ninterface\n\nimplementation\n\n" + "\n".join(f"procedure {w()}.{w()};\nbegin\n" + "\n".join(statement() for _ in range(rng.randrange(2, 9))) + "\nend;\n" for _ in range(statements // 12)) + "\nend.\n"


def test_repair_counts_by_hand():
    left, rules = H.repair(np.array([5, 6, 5, 6, 5, 6, 5, 6, 1, 2, 3]), np.array([0] * 8 + [1] * 3), 2)
    assert left.tolist()[1] == 3 and rules.tolist()[1] == 0
    assert left[0] + rules[0] <= 4
    run = H.repair(np.zeros(64, np.int64), np.zeros(64, np.int64), 1)
    assert run[0][0] + run[1][0] <= 9


def test_a_grammar_is_the_same_alone_and_among_others():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, n, size).astype(np.int64) for n, size in ((3, 500), (200, 900), (2, 1), (9, 4000), (2000, 60))]
    owner = np.repeat(np.arange(5), [len(x) for x in parts])
    left, rules = H.repair(np.concatenate(parts), owner, 5)
    alone = [H.repair(x, np.zeros(len(x), int), 1) for x in parts]
    assert left.tolist() == [int(a[0][0]) for a in alone] and rules.tolist() == [int(a[1][0]) for a in alone]


def test_data_in_the_frame_of_a_comment():
    rng = random.Random(2)
    table = "{\n" + ",\n".join(f'  "{rng.choice(WORDS)}": [{", ".join(str(rng.uniform(-9, 9))[:7] for _ in range(9))}]' for _ in range(40)) + "\n}\n"
    note = "{ " + " ".join(rng.choice(WORDS) for _ in range(200)) + " }"
    f = H._features([table, note])
    assert f["hard"][0] > 300 and f["literals"][0] > 300 and f["hard"][1] == 0


def test_shared_rules_agree_wherever_the_tokens_stand():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 60, 400, dtype=np.int64).view(np.uint64)
    b = np.concatenate([rng.integers(1, 1 << 60, 77, dtype=np.int64).view(np.uint64), a])
    (h, n, _), (g, m, _) = (H.shared_rules(x, np.zeros(len(x), int)) for x in (a, b))
    assert n.sum() == 400 and m.sum() == 477
    assert n[np.isin(h, g)].sum() > 340


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(4)
    foreign = [unit(rng, name=f"Foreign{i}") for i in range(6)]
    files = {f"hand{i}": unit(rng) for i in range(30)}
    files |= {f"mention{i}": "// values generated by the loom are checked here, do not edit the order\n" + unit(rng) for i in range(8)}
    mark = "{ Made by weaver 1.2. All changes will be lost. }\n"
    accessors = lambda: "\n".join(f"    function Get_{w}: WideString; safecall;\n    procedure Set_{w}(const Value: WideString); safecall;" for w in rng.sample(WORDS, 15))
    files |= {f"tool{i}": mark + f"unit T{i};\ninterface\ntype\n  TA = class(TB)\n{accessors()}\n  end;\nimplementation\nend.\n" for i in range(6)}
    files |= {f"toolhand{i}": mark + unit(rng) for i in range(3)}
    files |= {"data0": "unit D;\nconst\n  A: array[0..799] of Byte = (" + ", ".join(f"${rng.randrange(256):02X}" for _ in range(800)) + ");\nend.\n"}
    files |= {"data1": "unit E;\nconst\n  S =\n" + " +\n".join("    '" + "".join(rng.choice("ABCdef+/123") for _ in range(76)) + "'" for _ in range(40)) + ";\nend.\n"}
    files |= {"min0": "".join(x.strip().replace(" := ", ":=") + (" " if x.strip().isalpha() else "") for x in unit(rng, 120).splitlines())}
    files |= {"copy0": foreign[0].replace("Foreign0", "Renamed"), "copy1": foreign[1][:1500] + "\n// a change\n" + foreign[1][1500:], "short table": unit(rng).replace("interface", "interface\nconst\n  T: array[0..7] of Byte = (1, 2, 3, 4, 5, 6, 7, 8);", 1)}
    names = list(files)
    rows = [(i, files[n], "x") for i, n in enumerate(names)] + [(500, None, "x"), (501, "", "x"), (502, " \n", "x"), (None, files["data0"], "x"), (names.index("data0"), files["data0"], "x")]
    out = H.not_handwritten(spark.createDataFrame(rows, "file_id long, source_text string, reason string"), spark.createDataFrame([(t, "P") for t in [*foreign, None]], "source_text string, package string")).collect()
    assert len(out) == len({r.file_id for r in out})
    return {names[r.file_id]: r.reason for r in out}


def test_reasons(found):
    assert {k: v for k, v in found.items() if not k.startswith("tool")} == {"data0": "data", "data1": "data", "min0": "minified", "copy0": "vendored", "copy1": "vendored"}
    assert {k: v for k, v in found.items() if k.startswith("tool")} == {f"tool{i}": "generated" for i in range(6)} | {f"toolhand{i}": "marked" for i in range(3)}


def test_empty_tables(spark):
    files, up = spark.createDataFrame([], "file_id long, source_text string"), spark.createDataFrame([], "source_text string, package string")
    assert H.not_handwritten(files, up).count() == 0


def obfuscated(code, width=None):
    """``code`` with names that say nothing, run together and broken into lines of ``width``."""
    names = {}
    code = re.sub(r"\b(?:%s)(?:%s)\b" % (("|".join(w.title() for w in WORDS),) * 2), lambda m: names.setdefault(m[0], f"_{'lI'[len(names) % 2]}{len(names) + 16:x}"), code)
    if not width:
        return code
    flat = " ".join(code.split())
    return "\n".join(flat[i : i + width] for i in range(0, len(flat), width))


def test_wrapped_and_renamed_code_is_minified(spark):
    rng = random.Random(8)
    hand = [unit(rng, 120) for _ in range(3)]
    licence = "{ " + "\n  ".join(f"Clause {i} of a licence" for i in range(300)) + " }\n"
    flat = " ".join(hand[0].split())
    files = {f"wrapped{w}": "\n".join(flat[i : i + w] for i in range(0, len(flat), w)) for w in (150, 240)}
    files |= {"obfuscated": obfuscated(hand[1], 240), "renamed": obfuscated(hand[1]), "licensed": licence + " ".join(hand[2].split())}
    files |= {f"hand{i}": t for i, t in enumerate(hand)} | {"noted": "\n".join(x + " // why" for x in hand[0].splitlines()), "short": "unit A; interface implementation end."}
    names = list(files)
    out = H.not_handwritten(spark.createDataFrame([(i, files[n]) for i, n in enumerate(names)], "file_id long, source_text string"), spark.createDataFrame([], "source_text string, package string")).collect()
    assert {names[r.file_id]: r.reason for r in out} == dict.fromkeys(("wrapped150", "wrapped240", "obfuscated", "renamed", "licensed"), "minified")


def test_copies_of_packages_that_upstream_lacks(spark):
    rng = random.Random(11)
    foreign = [unit(rng, name=f"Foreign{i}") for i in range(6)]
    shared = unit(rng, 120)
    head = lambda kit, n: f"{{ {kit} 4.{n}, (C) 20{n + 10}-2023 the {kit} project\n  Homepage: https://{kit.lower()}.example/\n}}\n"
    rows = [(f"known{i}", f"lib{i % 3}", f"C:\\Libs\\lib{i % 3}\\1.0\\{('vendor', 'Third_Party')[i % 2]}\\Known{i}\\A{i}.pas", t) for i, t in enumerate(foreign)]
    rows += [(f"kit{i}", f"lib{i % 3}", f"/srv/lib{i % 3}-1.0/{('vendor', 'ThirdParty')[i % 2]}/Loom{i}Kit/B{i}.pas", head(f"Loom{i}Kit", i) + unit(rng)) for i in range(4)]
    rows += [(f"extern{i}", f"lib{i}", f"/srv/lib{i}-1.0/extern/Mill{i}Kit/C{i}.pas", head(f"Mill{i}Kit", i) + unit(rng)) for i in range(2)]
    rows += [(f"shared{i}", f"lib{i}", f"/srv/lib{i}-1.0/core/D{i}.pas", f"// copy {i}\n" + shared.replace("Hand", f"Own{i}")) for i in range(2)]
    rows += [(f"again{i}", "lib0", f"/srv/lib0-1.{i}/core/E.pas", foreign_free) for foreign_free in [unit(rng, 120)] for i in range(2)]
    rows += [(f"decoy{i}", f"lib{i % 3}", f"/srv/lib{i % 3}-1.0/{('vendor_invoices', 'ThirdPartyBilling', 'External/Api')[i % 3]}/F{i}.pas", unit(rng)) for i in range(9)]
    rows += [(f"licence{i}", f"lib{i % 3}", f"/srv/lib{i % 3}-1.0/core/G{i}.pas", f"{{ lib{i % 3} 4.1, (C) 2010-2023 the lib{i % 3} project\n  Homepage: https://lib{i % 3}.example/\n}}\n" + unit(rng)) for i in range(6)]
    rows += [("nowhere", None, None, unit(rng))]
    files = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "file_id long, library string, file_path string, source_text string")
    out = H.not_handwritten(files, spark.createDataFrame([(t, "P") for t in foreign], "source_text string, package string")).collect()
    assert {rows[r.file_id][0]: r.reason for r in out} == {r[0]: "vendored" for r in rows if r[0].startswith(("known", "kit", "extern", "shared"))}


def test_copies_of_a_unit_that_many_packages_have(spark):
    rng = random.Random(12)
    shared, own, part = unit(rng, 120), [unit(rng) for _ in range(7)], unit(rng, 240)
    up = [(t, f"P{i}") for i, t in enumerate(own)] + [(shared, f"P{i}") for i in range(7)]
    files = {"copy": shared.replace("Hand", "Renamed"), "one": own[3], "hand": part}
    rows = [(i, files[n]) for i, n in enumerate(files)]
    out = H.not_handwritten(spark.createDataFrame(rows, "file_id long, source_text string"), spark.createDataFrame(up, "source_text string, package string")).collect()
    assert {list(files)[r.file_id]: r.reason for r in out} == {"copy": "vendored", "one": "vendored"}


def test_copies_are_those_of_any_one_package(spark):
    rng = random.Random(13)
    widespread = lambda r: 0.9 if r < 20 else 0.4 if r < 60 else 0.05
    packages = {p: {r for r in range(120) if rng.random() < widespread(r)} | {120 + p, 121 + p} for p in range(40)} | {40 + p: {900, 901} for p in range(9)}
    files = []
    for i in range(300):
        mine = rng.sample(sorted(packages[rng.randrange(40)]), 6 if i % 2 else 14) if i % 3 else rng.sample(range(120), 12)
        rules = [(r, rng.randrange(4, 30)) for r in [*mine, *rng.sample(range(200, 400), 12), *([mine[0]] if i % 5 else []), *([900] if i % 7 == 0 else [])]]
        files.append((i, int(sum(n for _, n in rules) * rng.choice([0.4, 1.0, 1.5, 2.0])), rules))
    want = {i for i, t, rules in files if any(sum(n for r, n in rules if r in p) >= H.COPIED * t for p in packages.values())}
    each = spark.createDataFrame([(i, t, r, n) for i, t, rules in files for r, n in rules], "id long, tokens int, rule long, size int")
    foreign = spark.createDataFrame([(r, p) for p, rules in packages.items() for r in rules], "rule long, package long")
    assert 100 < len(want) < 200
    assert {r.id for r in H._copies(each, foreign).collect()} == want
    assert H._copies(each.limit(0), foreign).count() == 0 and H._copies(each, foreign.limit(0)).count() == 0
