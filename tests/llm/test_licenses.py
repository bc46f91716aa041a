import random
import re

import pyarrow as pa

from tidewater.llm import licenses as L


def test_unseen_notices():
    right = wrong = missed = 0
    for family, ws in L.made_examples(99, 6):
        got = L.brute_families(" ".join(ws))
        if family == L.CLEAN_CLASS:
            wrong += any(g != "unknown" for g in got)
        elif got == [family]:
            right += 1
        elif got and got[0] != "unknown":
            wrong += 1
        else:
            missed += 1
    assert right >= 0.9 * (right + missed) and wrong <= 0.02 * (right + missed)


DOCS = [
    (1, "Intro.\nReleased under the MIT License.\nMore."),
    (2, "This work is licensed under the GNU General Public License, version 3."),
    (3, "Licensed under CC BY-NC 4.0.\nAll rights reserved."),
    (4, "Licensed under the Apache License, Version 2.0."),
    (5, "He lost his driving license last year.\nThe table was reserved."),
    (6, "This text is licensed under the terms of the Foo Bar licence, version 9."),
    (7, None),
    (8, ""),
    (None, "Licensed under the BSD 3-Clause License"),
    (1, "Intro.\nReleased under the MIT License.\nMore."),
    (9, "license " * 5000 + "\n" + "licence-" * 5000),
]


def test_report_equals_brute_force(spark):
    df = spark.createDataFrame([(*d, "c") for d in DOCS], "doc_id long, text string, words string")
    rows = sorted(((r["doc_id"], r["families"], r["n_notices"], r["n_unknown"]) for r in L.license_report(df).collect()), key=str)
    want = []
    for d, t in DOCS:
        got = L.brute_families(t)
        known = [g for g in got if g != "unknown"]
        want.append((d, ",".join(sorted(set(known))), len(known), len(got) - len(known)))
    assert rows == sorted(want, key=str)
    named = dict((r[0], r[1]) for r in rows)
    assert named == {1: "MIT", 2: "GPL-3.0", 3: "CC-BY-NC-4.0,Proprietary", 4: "Apache-2.0", 5: "", 6: "", 7: "", 8: "", 9: "", None: "BSD-3-Clause"}
    assert L.license_report(df.limit(0)).count() == 0


def test_corpus_notices(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    said = {
        "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "All rights reserved.": "Proprietary",
    }
    want = {r["doc_id"]: ",".join(sorted({said[x] for x in r["text"].split("\n") if x in said})) for r in docs.collect()}
    assert sum(map(bool, want.values())) > 10
    assert {r["doc_id"]: r["families"] for r in L.license_report(docs).collect()} == want


def test_native(spark):
    plan = L.license_report(spark.createDataFrame(DOCS, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
MIT = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files"


def test_wrapped_notices(spark):
    docs = [(1, f"Intro.\n\n{GPL}\n\nMore."), (2, f"{MIT}\nAll rights reserved."), (3, MIT.replace("\n", "\n\n"))]
    rows = {r["doc_id"]: r for r in L.license_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[k]["families"] for k in (1, 2)] == ["GPL-3.0", "MIT,Proprietary"]
    assert "MIT" not in rows[3]["families"]
    for k, t in docs:
        got = L.brute_families(t)
        assert (rows[k]["n_notices"], rows[k]["n_unknown"]) == (sum(g != "unknown" for g in got), got.count("unknown"))


# Notices as their licences ask for them, wrapped as files have them.
NOTICES = {
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.""",
    "LGPL-3.0": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 3 of the License, or (at your option) any later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0""",
}


def test_notices_as_files_have_them(spark):
    docs, want = [], []
    for family, text in NOTICES.items():
        for mark in ("", " * ", "# ", "// "):
            docs.append((len(docs), "/*\n" + "\n".join(mark + x for x in text.split("\n")) + "\n\nimport os, sys\nprint('the general public met at the boost of version 2')\n"))
            want.append(family)
    clean = ["She has a license to teach and the public domain of the river is wide.", "All seats are reserved for members of the boost club, version 2.", "He asked for permission to enter the apache museum, and it was granted."]
    docs += [(len(docs) + k, t) for k, t in enumerate(clean)]
    got = {r["doc_id"]: r["families"] for r in L.license_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(docs))] == want + [""] * len(clean)


PROSE = "The river was wide and the people of the town went to the market in the morning with the goods they had made. "
PLACES = [
    ("\n".join(MIT.replace("\n", " ").split()), "MIT"),
    ("Licensed under the Apache\n" + "-" * 300 + "\nLicense, Version 2.0.", "Apache-2.0"),
    ("Released under the MIT License. All rights reserved.", "MIT,Proprietary"),
    (PROSE * 30 + "Released under the MIT License. " + PROSE * 30 + "Licensed under the Apache License, Version 2.0. " + PROSE * 30, "Apache-2.0,MIT"),
    ("# This is free and unencumbered software released into the public\n# domain.", "Unlicense"),
    (PROSE * 3 + GPL.replace("\n", "\n *\n * ") + PROSE * 3, "GPL-3.0"),
    (PROSE * 60 + "\n" + PROSE * 60, ""),
]


def test_notices_at_every_place(spark):
    docs = [(k, t) for k, (t, _) in enumerate(PLACES)]
    rows = {r["doc_id"]: r for r in L.license_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[k]["families"] for k, _ in docs] == [f for _, f in PLACES]
    for k, t in docs:
        got = L.brute_families(t)
        assert (rows[k]["n_notices"], rows[k]["n_unknown"]) == (sum(g != "unknown" for g in got), got.count("unknown"))


def test_runs_are_all_smallest(spark):
    rng = random.Random(3)
    texts = [L.TEMPLATES["GPL-3.0"][1], L.TEMPLATES["MIT"][1], L.TEMPLATES["Proprietary"][0]]
    pieces = [" ".join(L.words(t)[k : k + 6]) for t in texts for k in range(0, 18, 3)]
    docs = [(k, " ".join(rng.choice(pieces) for _ in range(12))) for k in range(6)]
    want = set()
    for d, t in docs:
        ws = L.words(t)
        for ps in (set(L._pairs(L.words(x))) for xs in L.TEMPLATES.values() for x in xs):
            has = lambda a, b: len(ps.intersection(zip_words(ws[a:b])))  # noqa: B023, E731
            for a in range(len(ws)):
                for b in range(a + 2, len(ws) + 1):
                    if (n := has(a, b)) >= L.SHARED * len(ps) and has(a + 1, b) < n and has(a, b - 1) < n:
                        want.add((d, a, b))
    found = L.blocks(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {(r["doc_id"], r["begin"], r["end"]) for r in L.runs(found, L._templates(spark)).collect()}
    assert len(want) > 50 and got == want


def zip_words(ws):
    return [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]


def test_stems_pass_no_notice_over():
    stems, passed = re.compile(L._STEMS), []
    for t in (t for ts in L.TEMPLATES.values() for t in ts):
        pairs = L._pairs(L.words(t))
        passed += [t] * (sum(not stems.search(p) for p in pairs) >= L.SHARED * len(pairs))
    assert passed == ["released under the unlicense"]
    for t in ("PUBLIC\n// Domain", "general  public", "cc-by"):
        assert re.search(L._ANY, t) and re.search(L._STEMS, " ".join(L.words(t)))


def plans_kept(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {x.executionId(): len(x.physicalPlanDescription()) for x in (found.apply(k) for k in range(found.size()))}


def test_plans_do_not_hold_the_model(spark):
    # the driver keeps the text of plans that have run, so each query would hold the model for good
    before = max(plans_kept(spark), default=-1)
    L.license_report(spark.createDataFrame(DOCS, "doc_id long, text string")).collect()
    new = [n for k, n in plans_kept(spark).items() if k > before]
    assert len(new) > 5 and max(new) < 200_000


def test_fixed_table_is_exact(spark):
    weights = L.train()["weights"]
    read = L._fixed_table(spark, [{"gram": g, "w": w} for g, w in weights.items()], {"gram": pa.string(), "w": pa.list_(pa.float64())})
    assert read.dtypes == [("gram", "string"), ("w", "array<double>")]
    assert {r["gram"]: r["w"] for r in read.collect()} == weights
