"""Titles whose price is no total, and titles whose price is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotlens.functions.vehicle import partial_reason

CASES = [
    ("Anticipo y saldo", "", "keyword: anticipo"),
    ("Anticipos desde 1.000.000", "", "keyword: anticipos"),
    ("Gol Trend 12 cuotas fijas", "", "keyword: 12 cuota"),
    ("Gol Trend en cuotas", "", "keyword: cuotas"),
    ("84 x $ 50.000", "", "keyword: 84 x $"),
    ("$ 90.000/mes", "", "keyword: /mes"),
    ("Plan Óvalo adjudicado", "", "keyword: plan ovalo"),
    ("Plan canje Cronos", "", "keyword: plan canje"),
    ("Planes de ahorro Cronos", "", "keyword: planes de ahorro"),
    ("Para suscribirse ya", "", "keyword: suscribirse"),
    ("Con senia se reserva", "", "keyword: senia"),
    ("Tomo seña", "", "keyword: sena"),
    ("Entrega inmediata $ 5.000.000", "", "keyword: entrega inmediata $ 5"),
    ("Entrega inmediata", "", None),
    ("Financiado 100 %", "", "keyword: financiado 100"),
    ("Financiación total", "", "keyword: financiacion total"),
    ("Crédito aprobado", "", "keyword: credito aprobado"),
    ("Crédito ya aprobado", "", "keyword: credito ya aprobado"),
    ("Polo 2024", "Llevate este Polo por . Solo $6.000.000", "keyword: precio total en blanco"),
    ("Polo 2024", "Anticipo y 12 cuotas", None),
    ("Planta en Córdoba, cuotero", "", None),
    (None, None, None),
]


def test_reasons(spark):
    df = spark.createDataFrame([(k, t, d) for k, (t, d, _) in enumerate(CASES)], "k int, t string, d string")
    got = {r.k: r.r for r in df.select("k", partial_reason(F.col("t"), F.col("d")).alias("r")).collect()}
    assert got == {k: r for k, (_, _, r) in enumerate(CASES)}
