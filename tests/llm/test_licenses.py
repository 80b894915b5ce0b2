import math
import re
import textwrap

from rejoinder.llm import licenses

SCHEMA = "doc_id long, text string, label string, n_words long, best double"
SEPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(doc_id, text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(SEPS, low) if x]
    at, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += own
        base |= {label} if own else set()
    best, added, most, met = 0.0, set(), 0.0, set()
    for label, own, span, must, bar in licenses.rules():
        for i in range(len(w)):
            block = set(w[i : i + span])
            if w[i] not in own or len(block & set(own)) < math.ceil(0.8 * len(own) - 1e-9):
                continue
            met.add(label)
            most = max(most, len(block & set(own)) / len(own))
            if block >= set(must) and not block & set(bar):
                added.add(label)
                best = max(best, len(block & set(own)) / len(own))
    return (doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | added)), 1.0 if base else best, ",".join(sorted(met)), most)


def test_equals_brute_force(spark):
    mit, cc = licenses.TEMPLATES["mit"][1], licenses.TEMPLATES["cc-by"][0]
    texts = [
        None, "", " ", "\x00\x7f", "Under the MIT License!", "under the mit license under the mit license", "cc by nc cc by nc cc-by-nc", "xcc by nc", "cc by ncx",
        "Licensed under CC BY-NC 4.0.", "Apache License, Version 2.0", "apache\nlicense version\n2", mit, mit.replace("Permission", "Leave"), " ".join(mit.split()[:9]), cc.upper(), "a\n" + cc + "\nunder the mit license",
        "This work is licensed under the GNU General Public License, version 3.", "é under the mit license é", "ünder the mit license", "word " * 50_000 + "cc by nc " + "word " * 50_000, "the the of a work is",
        "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0", cc.replace("Attribution", "Attribution-ShareAlike"), "This work is licensed under the GNU General Public License, version 2.", "Released under the Apache License",
        "Licensed under the \u212aAPACHE License, Version 2.0", "licensed under the GNU Lesser General Public License, version 3", "x " * 40 + licenses.TEMPLATES["cc-by-nc"][1] + " y" * 40 + " " + cc,
    ]
    rows = [(i, t, "l", 1, 1.0) for i, t in enumerate(texts)] + [(None, cc, "l", 1, 1.0), (3, cc, "l", 1, 1.0), (3, cc, "l", 1, 1.0)]
    got = licenses.license_scan(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute(r[0], r[1])) for r in rows)
    assert any(set(r.met_labels.split(",")) - set(r.labels.split(",")) - {""} for r in got)  # blocks that neighbours' words bar are told too
    assert licenses.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wrapped_notices_are_found(spark):
    rows, want = [], []
    for label, ts in licenses.TEMPLATES.items():
        for t in ts:
            for width in (24, 40, 60):
                for mark, end in (("", "\n"), (" * ", "\n"), ("# ", "\r\n"), ("dnl ", "\n\n")):
                    text = end.join(mark + line for line in textwrap.wrap(t, width))
                    rows.append((len(rows), f"One line before.\n{text}{end}One line after.", "l", 1, 1.0))
                    want.append(label)
    apart = "\n".join(w + " x" * 60 for w in licenses.word_list(licenses.TEMPLATES["bsd"][0]))  # its words, but no notice
    rows.append((len(rows), apart, "l", 1, 1.0))
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(rows[i][1], label) for i, label in enumerate(want) if label not in got[i].labels.split(",")] == []
    assert got[len(want)].labels == "" and got[len(want)].score == 0


def test_neighbouring_licenses_are_told_apart(spark):
    cc = licenses.TEMPLATES["cc-by"][0]
    given = {
        "Licensed under CC BY 4.0": "", "Licensed under CC BY-NC 4.0": "cc-by-nc", "Licensed under CC BY-NC-SA 4.0": "cc-by-nc", cc: "cc-by", cc.replace("Attribution", "Attribution-NonCommercial"): "cc-by-nc",
        "licensed under the GNU General Public License, version 2": "", "licensed under the GNU General Public License, version 3": "gpl-3", "Released under the Apache License": "", "Released under the MIT License": "mit",
    }
    rows = [(i, t, "l", 1, 1.0) for i, t in enumerate(given)]
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    # "cc by nc" stands in the third, so its base label stays
    assert [got[i] for i in range(len(rows))] == list(given.values())


def test_very_long_text(spark):
    """A million characters of a template's frequent words around two notices."""
    cc = licenses.TEMPLATES["cc-by"][0]
    text = "the software is a work of this license " * 12_000 + cc + " the of a and" * 30_000 + " Licensed under CC BY-NC 4.0"
    rows = [(1, text, "l", 1, 1.0), (2, "short", "l", 1, 1.0)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(text) > 800_000 and got[1].labels == "cc-by,cc-by-nc" and got[1].score == 1.0 and got[2].labels == ""
    assert got[1].n_words == len([w for w in re.split(SEPS, text.lower()) if w])
