"""A vault with more values of a class than four digits can number."""

from pyspark.sql import functions as F

from veilspark.operators import sanitize, spans, vault

N = 10_020


def test_reveal_and_forged_tokens_beyond_four_digits(spark):
    texts = spark.range(N).select("id", F.lit("v").alias("vault"), F.format_string("to u%05d@b.com, not [EMAIL_10000] or [PAN_123456]", "id").alias("text"))
    out, table = sanitize.sanitize(texts, "id", "vault", spans=spans.rule_spans(F.col("_text"), "email"))
    out, table = out.cache(), table.cache()
    clean = {r.id: r for r in out.where(f"id >= {N - 30}").collect()}
    assert table.count() == N and clean[N - 1].text == f"to [EMAIL_{N}], not (EMAIL-10000) or (PAN-123456)"
    assert [tuple(x) for x in clean[N - 1].forged] == [(21, 34), (38, 50)]
    back = {r.id: r.text for r in vault.reveal(out, table, ["id"]).collect()}
    assert back == {i: f"to u{i:05d}@b.com, not (EMAIL-10000) or (PAN-123456)" for i in range(N)}
