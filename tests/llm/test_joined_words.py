"""Insults in tokens of several parts and in tokens too long to decode at once."""

from __future__ import annotations

import pytest

from tallyfield.llm import toxicity

CLEAN = "you are such an amazing person and the cat sat on a mat with some trash in the house while we are all at home "


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(1, (CLEAN + "you idiot ") * 50)], "doc_id bigint, text string")
    return toxicity.CharModel(toxicity.trigram_counts(docs))


LONG = ["y.o.u.a.r.e.s.u.c.h.a.n.a.m.a.z.i.n.g.i.d.i.o.t", "you_are_such_an_amazing_person_and_an_idiot", "i" * 20 + "d" * 20 + "i" * 9 + "ooot", "y0uaresuchanamazingpersonandthecatsat4nidiot"]
JOINED = ["you,idiot", "trash/idiot", "you,id-iot", "you,1d1ot", "y.o.u.i.d.i.o.t", "you,i.d.i.o.t"]


@pytest.mark.parametrize("token", LONG + JOINED)
def test_words_of_a_joined_token(spark, model, token):
    docs = spark.createDataFrame([(1, f"the {token} sat"), (2, "the cat sat")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model, {"idiot": 0.9}, 0.1).collect()}
    assert got[1].words == ["idiot"] and got[1].predicted == 1
    assert got[2].words == [] and got[2].predicted == 0


def test_words_inside_parts_do_not_count(spark, model):
    docs = spark.createDataFrame([(1, "a physio-therapist and a semi-idiotic,plan")], "doc_id bigint, text string")
    assert toxicity.score(docs, model, {"rapist": 0.9, "idiot": 0.9}, 0.1).first().words == []
