import pytest

from geoweft.llm import licences

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (MIT, "MIT"), ("Released under the MIT License.", "MIT"), ("Text. Licensed under CC BY-NC 4.0.\nMore", "CC-BY-NC-4.0"),
        ("Licensed under the Apache License, Version 2.0.  Released under the MIT License.", "Apache-2.0,MIT"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
        ("We like the MIT License.", ""), ("Licensed under the Apache License", ""), ("", ""), (None, ""), ("no words here", ""),
    ],
)
def test_texts(spark, text, found):
    assert licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["licences"] == found


def test_more_sentences_take_the_specific_rule(spark):
    three = [licences.SENTENCES[i] for i in (10, 11, 12)]
    four = [*three, licences.SENTENCES[13]]
    docs = spark.createDataFrame([(0, ". ".join(three)), (1, ".\n".join(four)), (2, ". ".join(reversed(four)))], "doc_id long, text string")
    assert [r.licences for r in licences.scan_licences(docs).orderBy("doc_id").collect()] == ["BSD-2-Clause", "BSD-3-Clause", ""]


def test_tables():
    assert all(any(a in s for a in licences.ANCHORS) for s in licences.SENTENCES.values())
    assert len(set(licences.SENTENCES.values())) == len(licences.SENTENCES)
    assert {i for _, ids in licences.RULES for i in ids} <= set(licences.SENTENCES)
    for k, (_, ids) in enumerate(licences.RULES):
        assert not any(ids[: len(earlier)] == earlier for _, earlier in licences.RULES[:k]), "an earlier rule hides it"
