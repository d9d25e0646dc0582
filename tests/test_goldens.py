"""Goldens from the reference's committed run logs (arithmetic only)."""

import pytest

from flowsentry.operators import metrics as M
from flowsentry.operators import stats as A
from flowsentry.operators.sample import allocate

# Confusion matrices [[tn, fp], [fn, tp]] printed by the reference, with the
# report figures it printed for them (4 digits).
CONFUSION_GOLDENS = {
    "nsl_tree": ([[9407, 304], [4536, 8297]], {"accuracy": 0.7853, "p1": 0.9647, "r1": 0.6465, "f1": 0.7742,
                                              "macro_f1": 0.7848, "weighted_f1": 0.7833}),
    "nsl_forest": ([[9448, 263], [5039, 7794]], {"accuracy": 0.7648, "f1": 0.7462, "macro_f1": 0.7635,
                                                "weighted_f1": 0.7611}),
    "cic_tree": ([[7998, 13], [13, 1976]], {"accuracy": 0.9974, "f1": 0.9935}),
    "zero_division": ([[83, 0], [17, 0]], {"p1": 0.0, "r1": 0.0, "f1": 0.0, "macro_f1": 0.4536,
                                          "weighted_f1": 0.7529}),
}

# NSL-KDD training class counts from the reference's distribution printout.
NSL_TRAIN_COUNTS = {
    "normal": 67343, "neptune": 41214, "satan": 3633, "ipsweep": 3599, "portsweep": 2931, "smurf": 2646,
    "nmap": 1493, "back": 956, "teardrop": 892, "warezclient": 890, "pod": 201, "guess_passwd": 53,
    "buffer_overflow": 30, "warezmaster": 20, "land": 18, "imap": 11, "rootkit": 10, "loadmodule": 9,
    "ftp_write": 8, "multihop": 7, "phf": 4, "perl": 3, "spy": 2,
}

# Per-class sizes of the reference's stratified samples of 50, 500 and 1500 rows.
STRATA_GOLDENS = {
    50: {"normal": 27, "neptune": 16, "ipsweep": 2, "satan": 2, "smurf": 1, "nmap": 1, "portsweep": 1},
    500: {"normal": 267, "neptune": 164, "ipsweep": 14, "satan": 14, "portsweep": 12, "smurf": 10, "nmap": 6,
          "teardrop": 4, "warezclient": 4, "back": 4, "pod": 1},
    1500: {"normal": 802, "neptune": 491, "satan": 43, "ipsweep": 43, "portsweep": 35, "smurf": 32, "nmap": 18,
           "warezclient": 11, "teardrop": 11, "back": 11, "pod": 2, "guess_passwd": 1},
}


def _report(spark, mat):
    rows = [(i, j, mat[i][j]) for i in range(2) for j in range(2)]
    conf = spark.createDataFrame(rows, "label int, pred int, n long")
    return {r["row"]: r for r in M.report_from_confusion(conf).collect()}


@pytest.mark.parametrize("name", list(CONFUSION_GOLDENS))
def test_report_goldens(spark, name):
    mat, exp = CONFUSION_GOLDENS[name]
    rep = _report(spark, mat)
    got = {"accuracy": rep["accuracy"]["f1"], "p1": rep["1"]["precision"], "r1": rep["1"]["recall"],
           "f1": rep["1"]["f1"], "macro_f1": rep["macro avg"]["f1"], "weighted_f1": rep["weighted avg"]["f1"]}
    for k, v in exp.items():
        assert round(got[k], 4) == pytest.approx(v, abs=1e-9), (name, k, got[k])


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0)] * 83 + [(1, 0)] * 17, "y int, pred int")
    r = M.binary_metrics(df).collect()[0]
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)
    assert r["accuracy"] == pytest.approx(0.83)


@pytest.mark.parametrize("counts,expected", [
    ((67343, 58630), (0.9353087923, 1.0743049633)),
    ((80394, 19606), (0.6219369605, 2.5502397225)),
])
def test_class_weight_goldens(spark, counts, expected):
    from pyspark.sql import functions as F
    n0, n1 = counts
    df = spark.range(n0 + n1).select(F.when(F.col("id") < n0, 0).otherwise(1).alias("y"))
    w = {r["y"]: r["weight"] for r in A.class_weights(df, "y").collect()}
    assert w[0] == pytest.approx(expected[0], abs=1e-9)
    assert w[1] == pytest.approx(expected[1], abs=1e-9)


@pytest.mark.parametrize("n", [50, 500, 1500])
def test_stratified_allocation_goldens(n):
    got = {k: v for k, v in allocate(NSL_TRAIN_COUNTS, n).items() if v}
    assert got == STRATA_GOLDENS[n]


def test_class_distribution_pct(spark):
    rows = [(k,) for k, v in NSL_TRAIN_COUNTS.items() for _ in range(v)]
    df = spark.createDataFrame(rows, "label string")
    got = {r["class_label"]: r["pct"] for r in A.class_distribution(df, "label").collect()}
    assert got["normal"] == 53.458 and got["neptune"] == 32.717 and got["spy"] == 0.002
