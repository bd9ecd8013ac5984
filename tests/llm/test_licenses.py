import random

from prospector.llm import licenses as ls


def test_held_out_accuracy():
    rows = ls.training_rows(random.Random(99), 1)
    right = wrong = missed = 0
    for text, family in rows:
        got = [m for m in ls.brute_force(text) if m[3]]
        found = {m[1] for m in got}
        right += family in found or (family == ls.UNKNOWN and not found)
        wrong += bool(found - {family})
        missed += family != ls.UNKNOWN and not found
    assert right >= 0.85 * len(rows)
    assert wrong <= 0.03 * len(rows)


def test_known_and_unknown_statements():
    kind = lambda t: [(m[1], m[3]) for m in ls.brute_force(t)]
    assert kind("Released under the MIT License.") == [("mit", True)]
    assert kind("Licensed under CC BY-NC 4.0.") == [("cc-by-nc", True)]
    assert kind("Licensed under the Apache License, Version 2.0.") == [("apache", True)]
    assert kind("This work is licensed under the GNU General Public License, version 3.") == [("gpl", True)]
    assert kind("The license plate was lost.") == [("unknown", False)]
    assert kind("Licensed under the Acme Public Agreement.") == [("unknown", False)]
    assert kind("nothing here") == []


def test_name_after_a_colon_or_semicolon():
    kind = lambda t: [(m[1], m[3]) for m in ls.brute_force(t)]
    assert kind("SPDX-License-Identifier: MIT") == [("mit", True)]
    assert kind("License: MIT") == [("mit", True)]
    assert kind("// SPDX-License-Identifier: Apache-2.0") == [("apache", True)]
    assert kind("See the license; MIT") == [("mit", True)]
    assert kind("License: see the vendor.") == [("unknown", False)]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
WRAPPED = {
    "mit": MIT, "bsd": BSD, "isc": ISC, "mit,": f"Copyright (c) 2020 The Authors\n\n{MIT}\n\n{DISCLAIMER}", "isc,": f"{ISC}\n{DISCLAIMER}", "bsd,": "\r\n".join(BSD.split("\n")),
    "mit,,": "/*\n" + "\n".join(f" * {line}".rstrip() for line in f"{MIT}\n\n{DISCLAIMER}".split("\n")) + "\n */", "isc,,": f"Some words first.\n{ISC} More words.\nThe last line.",
}


def test_wrapped_texts(spark):
    for key, text in WRAPPED.items():
        assert {m[1] for m in ls.brute_force(text) if m[3]} == {key.strip(",")}, key
    both = f"Some words.\n{BSD}\nA line.\n{ISC}\nReleased under the Apache License 2.0.\nOther words."
    assert {m[1] for m in ls.brute_force(both) if m[3]} == {"bsd", "isc", "apache"}
    assert [(m[0], m[1], m[3]) for m in ls.brute_force("Released under the MIT License.\nLicensed under CC BY-NC 4.0.")] == [(0, "mit", True), (1, "cc-by-nc", True)]
    assert [m[3] for m in ls.brute_force("He asked for permission to\nspeak.\n\nThe licence\nplate.")] == [False, False]
    texts = [*WRAPPED.values(), both, "\n".join(WRAPPED.values()), "\n\n".join(WRAPPED.values()), "\n \n*\n" + MIT + "\n\n\n", "a\n\nthe licence \n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in ls.license_scan(df).collect():
        got = [(m["paragraph"], m["family"], round(m["probability"], 9), m["confirmed"], m["template"]) for m in r["license_matches"]]
        assert got == [(i, f, round(p, 9), c, t) for i, f, p, c, t in ls.brute_force(r["text"])], r["doc_id"]


def test_older_names_and_public_domain():
    said = {
        "It comes under the terms of the GNU Library General Public License.": {"lgpl"},
        "Covered by the Mozilla Public License, version 1.1.": {"mpl"},
        "This file is hereby placed in the public domain.": {"public-domain"},
        "The code was released into the public domain.": {"public-domain"},
        "No copyright is claimed.": {"public-domain"},
        "Many old books are in the public domain.": set(),
        "She sang in the public square.": set(),
    }
    for text, want in said.items():
        assert {m[1] for m in ls.brute_force(text) if m[3]} == want, text


def test_scan_matches_plain_python(spark):
    rng = random.Random(4)
    texts = [t for t, _ in rng.sample(ls.training_rows(rng, 1), 120)]
    texts += ["\n".join(rng.sample(texts, 5)), None, "", "\n\n", "mit unter MIT", "x " * 20000 + "Released under the MIT License. " + "y " * 20000, texts[0], "É" * 50 + " licença MIT"]
    rows = [(i, t, "own", 1) for i, t in enumerate(texts)] + [(None, texts[0], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license_matches string, family int")
    for r in ls.license_scan(df).collect():
        got = [(m["paragraph"], m["family"], round(m["probability"], 9), m["confirmed"], m["template"]) for m in r["license_matches"]]
        assert got == [(i, f, round(p, 9), c, t) for i, f, p, c, t in ls.brute_force(r["text"])], r["doc_id"]
    assert ls.license_scan(df.limit(0)).count() == 0


def test_driver_documents(spark):
    out = ls.op1(spark, "/root/testdata/sf0.001")
    assert out.count() == 200
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in out.collect():
        stated = {f for f, t in (("mit", "the MIT License."), ("apache", "Apache License, Version 2.0"), ("gpl", "GNU General Public License, version 3"), ("cc-by-nc", "CC BY-NC 4.0")) if t in docs[r["doc_id"]]}
        assert set(filter(None, r["families"].split(","))) == stated


GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
OLD_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def test_licences_that_share_a_statement_with_a_family_are_told_apart(spark):
    """Terms of other licences in the next lines, wrapped and behind comment marks too, or their words in the statement; far away they say nothing."""
    term = "Except as contained in this notice, the name of X shall not be used in advertising."
    texts = {
        "mit": (GRANT, {"mit"}),
        "x11": (f"{GRANT}\n\n{term}", set()),
        "wrapped": (f" * {GRANT}\n *\n * Except as contained\n * in this notice, the name", set()),
        "before": (f"{term}\n\n{GRANT}", {"mit"}),
        "far": (GRANT + "\n" * (ls.REACH + 1) + term, {"mit"}),
        "last": (GRANT + "\n" * ls.REACH + "except as contained in this notice", set()),
        "khronos": (GRANT.replace("deal in the Software", "deal in the Materials"), set()),
        "isc": (OLD_ISC, {"isc"}),
        "curl": (f"{OLD_ISC}\n{term}", set()),
        "old": (OLD_ISC.replace("this software", "this software and its documentation"), set()),
        "joined": (OLD_ISC.replace(" any purpose", "\nany purpose") + f"\n\n{term}", set()),
        "name": (f"License: ISC License\n{OLD_ISC}\n", {"isc"}),
        "sleepycat": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n3. Redistributions in any form must be accompanied by information on how to obtain complete\nsource code", set()),
        "gpl": (f"This program is licensed under the GNU General Public License version 2.\n{term}", {"gpl"}),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "k string, text string")
    got = {r["k"]: r["license_matches"] for r in ls.license_scan(df).collect()}
    for k, (text, want) in texts.items():
        assert {m["family"] for m in got[k] if m["confirmed"]} == want, k
        assert [(m["paragraph"], m["family"], m["confirmed"], m["template"]) for m in got[k]] == [(p, f, c, t) for p, f, _, c, t in ls.brute_force(text)], k
        assert all((m["template"] is not None) == m["confirmed"] for m in got[k])
