import random
import re

from test_llm_operators import base_places, rows

from lumenfold.llm import license


def test_separators_of_every_kind(spark):
    """Phrases joined by underscores, line breaks and several blanks, compared with brute force."""
    rng = random.Random(6)
    parts = ["under", "the", "mit", "license", "Apache", "version", "2", "CC", "by", "nc", "é", "accuse", "thunder"]
    gaps = ["_", "\n", "  ", "-", "\t", "__", " \r\n "]
    phrases = [*license.BASE, "cc by nc", "CC BY NC"]
    texts = [p.replace(" ", g) for p in phrases for g in gaps]
    texts += ["".join(x for w in rng.choices(parts, k=50) for x in (w, rng.choice(gaps))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(license.license_labels(df))
    for i, t in enumerate(texts):
        n, at = base_places(t)
        starts = [a for a, _ in at]
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"]) == (n, len(at), min(starts, default=None), max(starts, default=None)), t
        assert got[i]["base_labels"] == ",".join(sorted({b for _, b in at}))


def test_rules_do_not_depend_on_separators(spark):
    phrases = {"released under the gpl": "gpl", "governed by the GPL": "gpl", "subject to the terms of the CC BY SA": "cc-by-sa", "covered by the mpl": "mpl", "according to the ISC": "isc", "no terms under cc": ""}
    cases = [(p.replace(" ", g), label) for p, label in phrases.items() for g in ("_", "\n", "  ", "-\n")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = rows(license.license_labels(df))
    assert [(t, got[i]["labels"]) for i, (t, _) in enumerate(cases)] == cases


def spellings(names):
    """Every alternative of a family's regular expression, in its shortest and its longest form."""
    from re import _parser as parser

    def out(tree, most):
        texts = [""]
        for op, arg in tree:
            kind = str(op)
            if kind == "LITERAL":
                more = [chr(arg)]
            elif kind == "IN":
                more = [chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else chr(arg[0][1][0])]
            elif kind == "BRANCH":
                more = [x for branch in arg[1] for x in out(branch, most)]
            elif kind == "SUBPATTERN":
                more = out(arg[-1], most)
            else:
                assert kind == "MAX_REPEAT"
                more = out(arg[2], most) if (arg[1] if most else arg[0]) else [""]
            texts = [a + b for a in texts for b in more]
        return texts

    tree = parser.parse(f"(?:{names})")
    return sorted({x for most in (False, True) for x in out(tree, most)})


def test_every_name_is_found_in_every_form(spark):
    forms = ["SPDX-License-Identifier: {}", "licensed under the {}", "released under the {}", "governed by the {}", "under the {}", "{} license", "license is {}"]
    cases = [(label, form.format(name)) for label, _, names in license.FAMILIES for name in spellings(names) for form in forms]
    assert len(cases) > 1000 and ("mit", "licensed under the expat") in cases and ("bsl-1", "bsl 1 0 license") in cases
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string").repartition(4)
    got = rows(license.license_labels(df))
    assert [c for i, c in enumerate(cases) if c[0] not in got[i]["labels"].split(",")] == []


def plain_detections(text):
    """Every rule by Python's re over the words, without gates; containment and priority by comparing all pairs."""
    w = re.findall(license.WORD, text.translate(str.maketrans(license.UPPER, license.LOWER)))
    joined = " " + " ".join(w) + " "
    found = []
    for r in license.rules():
        for m in re.finditer(r["regex"], joined):
            start = joined[: m.start()].count(" ")
            found.append((start, start + m[0].count(" "), r["priority"], r["label"]))
    keep = []
    for d in found:
        inside = lambda o: o[0] <= d[0] and d[1] <= o[1] and ((o[1] - o[0]) > (d[1] - d[0]) or o[2] < d[2])  # noqa: B023, E731
        if not any(inside(o) for o in found):
            keep.append(d)
    return sorted(keep)


def test_detections_equal_a_plain_matcher(spark):
    rng = random.Random(4)
    wordings = [re.sub(r"\(\?[:!][^()]*\)\??|\[[^\]]*\][?+*]?|[?^$|()]", "", r) for _, _, r, _ in license.SIGNATURES]
    names = ["MIT", "Apache License, Version 2.0", "GPL v3", "GNU_GPL", "BSD-3-Clause", "CC-BY-NC-SA 4.0", "cc_by_nc", "Mozilla Public License 2.0", "public domain", "zlib/libpng"]
    forms = ["Licensed under the {}", "SPDX-License-Identifier: {}", "released under the terms of the {}", "{} license", "see creativecommons.org/licenses/by-nc/4.0 or {}", "under the MIT license and {}", "{}"]
    texts = {}
    for i in range(250):
        parts = [rng.choice(forms).format(rng.choice(names)) for _ in range(rng.randint(0, 3))] + rng.sample(wordings, rng.randint(0, 2)) + rng.choices(["word", "é", "under", "license", "cc", "the", "gnu"], k=rng.randint(0, 6))
        rng.shuffle(parts)
        texts[i] = rng.choice([" ", "\n", "_", " - ", "é "]).join(parts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: sorted((d["start"], -d["before"], d["priority"], d["label"]) for d in r["detections"]) for r in license.license_scan(df).collect()}
    want = {k: plain_detections(t) for k, t in texts.items()}
    assert got == want and sum(len(v) for v in want.values()) > 250
    assert len({r["label"] for r in license.rules()}) > 40
