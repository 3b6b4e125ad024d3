from pyspark.sql import functions as F

from tabloom.operators.encode import activate_groups
from tabloom.plans.enhance import enhance


def test_spellings_that_cleaning_merges_are_one_category(spark):
    kinds = ["Machinery", " MACHINERY ", "machinery", "Tools", "Paper"]
    full = spark.createDataFrame([(i, kinds[i % 5], float(i)) for i in range(100)], "`Key No` long, Kind string, x double")
    sample = full.where(F.col("Kind") == " MACHINERY ")
    got = enhance(sample, full, ["kind"], "key_no", n=4)
    assert {r["kind"] for r in got.added.collect()} == {"tools", "paper"} and got.added.count() == 8
    cover = got.coverage.first()
    assert (cover["n_before"], cover["n_after"], cover["n_new"]) == (1, 3, 2)
    assert {c for c in got.encoded.columns if c.startswith("kind")} == {"kind_machinery", "kind_paper", "kind_tools"}
    assert got.encoded.count() == sample.count() + 8


def test_group_rules(spark):
    flags = ["p_relative_size_xl", "p_relative_size_l", "p_relative_size_nan", "o_organisation_type_software", "o_organisation_type_other",
             "misc_yes", "misc_missing", "plain"]
    rows = [("Large", "Large Enterprise"), ("XLarge", None), (None, "shop"), ("Medium", "GOVERNMENT")]
    df = spark.createDataFrame(rows, "project_prf_relative_size string, external_eef_organisation_type string")
    got = [[f for f in flags if r[f]] for r in activate_groups(df, flags).collect()]
    # "l" is first found in "..._xl", as flags are searched in their order; a rule whose flag is missing turns nothing on
    assert got == [["p_relative_size_xl", "o_organisation_type_software", "misc_missing"],
                   ["p_relative_size_xl", "o_organisation_type_other", "misc_missing"],
                   ["p_relative_size_nan", "o_organisation_type_other", "misc_missing"],
                   ["misc_missing"]]
