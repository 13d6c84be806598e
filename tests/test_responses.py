"""The check of a response against one that goes through it rule by rule."""

from __future__ import annotations

from collections import Counter

from tallyfield.operators import responses

ANSWERS = "game int, cohorts array<struct<bucket:string,summary:string,claim_ids:array<string>>>, flag_sentences array<struct<flag_id:string,sentence:string>>"


def checked(spark, answer, cohorts, claims, flags):
    frames = [
        spark.createDataFrame([(1, *answer)], ANSWERS),
        spark.createDataFrame([(1, *c) for c in cohorts], "game int, bucket string, muted boolean"),
        spark.createDataFrame([(1, *c) for c in claims] + [(2, "a", "early")], "game int, claim_id string, bucket string"),
        spark.createDataFrame([(1, f) for f in flags] + [(2, "other")], "game int, flag_id string"),
    ]
    return Counter(r.code for r in responses.check_response(*frames).collect())


COHORTS = [("early", False), ("mid", False), ("veteran", True), ("refund_window", False)]
CLAIMS = [("a", "early"), ("b", "early"), ("m", "mid"), ("v", "veteran")]


def test_response_that_is_usable(spark):
    answer = ([("early", "Fine.", ["a", "b"]), ("mid", "Good on Windows 11.", ["m"]), ("veteran", " ", [])], [("shape", "It fell.")])
    assert checked(spark, answer, COHORTS, CLAIMS, ["shape"]) == {}  # a live cohort without claims needs no answer


def test_response_with_every_fault(spark):
    answer = (
        [("early", "The majority of 7 people left, the Majority!", ["a", "m", "x", "a", "x", None]), ("veteran", "Said.", None), ("veteran", None, ["v"]), ("none", "Most players agree.", ["a"]), (None, None, None), ("early", None, ["a"])],
        [("shape", "Half of players left after 3 days."), ("made_up", None), (None, "x")],
    )
    assert checked(spark, answer, COHORTS, CLAIMS, ["shape", "recency"]) == Counter(
        {
            "cohort_not_answered:mid": 1, "flag_not_described:recency": 1, "unknown_flag_id:made_up": 1, "unknown_flag_id:None": 1, "unknown_bucket:none": 1, "unknown_bucket:None": 1,
            "muted_cohort_has_content:veteran": 2, "claim_moved_cohort:m(from mid to early)": 1, "unknown_claim_id:x": 2, "unknown_claim_id:None": 1, "claim_reused:a": 2,
            "digit_in_prose:summary[early]": 1, "prevalence:summary[early]:Majority,majority": 1, "prevalence:summary[none]:Most": 1,
            "digit_in_prose:flag[shape]": 1, "prevalence:flag[shape]:Half of players": 1,
        }
    )


def test_response_that_answers_nothing(spark):
    for answer in (([], []), (None, None)):
        assert checked(spark, answer, COHORTS, CLAIMS, ["shape"]) == Counter({"cohort_not_answered:early": 1, "cohort_not_answered:mid": 1, "flag_not_described:shape": 1})
