"""Two chunk plans: accepted and rejected repairs, and odd documents."""

from tessera.operators import plan_choice

SCHEMA = "doc_id long, all array<struct<n: int, length: int, kind: string, density: double, refs: int, bits: int, head: string>>"
FINDINGS, ORDERED = plan_choice._BIT["findings"], plan_choice._BIT["disposition"]


def para(n, length, kind="general_body", refs=0, bits=0, head=None):
    return (n, length, kind, refs * 1000.0 / length, refs, bits, head)


def test_accepted_and_rejected(spark):
    plain = [para(k, 300) for k in range(6)]
    shifting = [para(0, 300, "findings", 0, FINDINGS), para(1, 300, "holding_disposition", 2, ORDERED), para(2, 200, "findings", 0, FINDINGS)]
    typed = [para(0, 20, "heading", head="findings"), para(1, 300, "findings", 0, FINDINGS), para(2, 25, "heading", head="holding_disposition"), para(3, 400, "holding_disposition", 0, ORDERED)]
    rows = [(1, plain), (2, shifting), (3, typed), (4, [])]
    found = {r.doc_id: r for r in plan_choice.compared(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1].candidate and not found[1].reasoned and not found[1].accepted
    assert found[2].candidate and found[2].accepted and "boundaries" in found[2].better
    assert not found[3].candidate and not found[3].accepted  # it has sections to go by
    assert not found[4].accepted and found[4].a.n == 0 == found[4].b.n


def test_given_documents_have_both(spark):
    rows = plan_choice.plan_comparison(spark, "/root/testdata/sf0.001").collect()
    assert {r.accepted for r in rows} == {True, False}
    assert all(r.n_kept == (r.repaired_n if r.accepted else r.plain_n) for r in rows)


def test_signals_are_found_once(spark):
    """One search for each signal in either half of the union: failed before."""
    setting = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "100000")
    try:
        plan = plan_choice._listed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(setting, before)
    assert plan.count("ordered|granted|denied") == 2
