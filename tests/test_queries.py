"""Every registered query of the library's own operators against its SQL."""

import os

import duckdb
import pytest

from utrflow.plans import queries, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES + ["labels"]:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    cursor = con.execute(registry.ORACLE_SQL[name])
    want, names = cursor.fetchall(), [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted(map(tuple, want), key=key)


def test_annotation_with_all_tables_returns_its_columns(spark):
    from utrflow.operators import annotate

    assert queries.q60_annotation_tables(spark, SF).columns == annotate.COLUMNS


def test_annotation_meets_its_tables_once_by_place(spark):
    plan = queries.q60_annotation_tables(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__bin") and plan.count("Join ") <= 8  # isoforms, all intervals, what they tell, predictions, three exact tables


def test_annotation_of_repeated_variants_and_null_infos(spark):
    from utrflow.operators import annotate

    v = spark.createDataFrame([("chrA", 10, 11, "A", "G", "i"), ("chrA", 10, 11, "A", "G", "i"), ("chrA", 10, 11, "A", "C", "i"), ("chrA", 40000, 40001, "A", "G", "j"), ("chrB", 10, 11, "A", "G", "k")], 'chrom string, start long, end long, ref string, alt string, id string')
    utr = spark.createDataFrame([("chrA", 0, 50000, "g", ".", "+", 1, 1, 0, 50000), ("chrB", 5, 20, "h", ".", "+", 1, 1, 5, 20)], "chrom string, iso_start long, iso_stop long, gene string, score string, strand string, number_isos long, iso_loc long, utr_start long, utr_stop long")
    spans = lambda *rows, name="info": spark.createDataFrame(rows, f"chrom string, r_start long, r_end long, {name} string")
    told = spark.createDataFrame([("m", "f1", "s", "p", "+", "c", "consFam", "1"), ("m", "f2", "s", "p", "+", "c", "consFam", "1")], "mergekey string, family string, seed_match string, pct string, strand string, context string, family_conserved string, site_conserved string")
    tables = annotate.Annotations(utr, eqtl=spans(("chrA", 5, 15, None), ("chrA", 0, 12, "e"), ("chrA", 9, 12, "e")), gwas=spans(("chrA", 8, 12, "y"), ("chrA", 0, 50000, "z"), ("chrA", 9, 12, None), ("chrA", 9, 12, "y")), mir_sites=spans(("chrA", 5, 15, "m"), ("chrA", 6, 15, "m"), ("chrA", 6, 15, "n"), name="mergekey"), mir_predictions=told)
    for collapse in (False, True):
        rows = annotate.annotate(annotate.single_nucleotide(v), tables, collapse).collect()
        got = sorted((r["var_id"], r["eqtl_info"] or "", r["gwas_info"] or "", r["miR_info"] or "") for r in rows)
        mir = "m__f1__s__p__+__c__consFam__1|m__f2__s__p__+__c__consFam__1|n__nonCons_family"
        near = [(f"chrA_11_A_{alt}", e, "z|y|y", mir) for alt in "CGG" for e in (["e"] if collapse else ["", "e"])]
        assert got == sorted([*near, ("chrA_40001_A_G", "", "z", ""), ("chrB_11_A_G", "", "", "")])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_letters_are_cut_out_once_and_counted_without_patterns(spark):
    assert plan_of(queries.reads(spark, SF)).count("regexp_replace") == 1
    assert plan_of(queries.q29_entropy(spark, SF)).count("regexp_replace") == 2  # the read, and its share of G and C


def test_windows_are_scored_once_and_not_by_read(spark):
    assert "BroadcastHashJoin" in plan_of(queries.q20_disruption(spark, SF))


def test_best_hits_sort_no_windows(spark):
    from utrflow.operators import kmers

    x = queries.reads(spark, SF)
    assert "SortAggregate" not in plan_of(kmers.best_hits(x, queries._ranks(spark, SF), 4, ["lang"]))


def test_all_have_sql_but_iterative_ones():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"q33_ska", "q34_descent", "q49_motif_seeds", "q81_mean_field_fit", "q83_calibration"}


def test_no_python_and_no_cartesian_in_interval_plan(spark):
    plan = queries.q01_overlap_collapse(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Python" not in plan and "NestedLoop" not in plan
