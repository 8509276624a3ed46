"""The whole set of queries on tables stored under their declared schemas."""

import pytest
from pyspark.sql import functions as F

from fixtures.views import VIEWS, Survey as Fixture
from trapline.plans import associations, microbes, sites, species, studies
from trapline.sources.layers import write_regions
from trapline.sources.tables import conform, table_schema
from trapline.survey import open_survey


@pytest.fixture(scope="module")
def survey(spark, small_dir, tmp_path_factory):
    source, target = Fixture.open(spark, small_dir), tmp_path_factory.mktemp("survey")
    raw = {name: source._view(VIEWS[f"fx_{name}"]) for name in ("species", "pathogen", "rodent_summary")}
    raw["species"] = raw["species"].withColumn(
        "presence_absence", F.when(F.col("pa_colour") == "orange", "Presence").otherwise("Absence")
    )
    raw |= {"studies": source.studies, "studies_all": source.studies, "spatial": source.spatial}
    raw |= {"level_0": source.level_0, "level_2": source.level_2}
    for name, table in raw.items():
        conform(table, table_schema(name), name).write.parquet(f"{target}/{name}.parquet")
    return open_survey(spark, str(target))


def test_every_query_runs_on_declared_tables(survey, tmp_path):
    host = survey.pathogen.select("classification").first()[0]
    results = {
        "years": studies.studies_per_year(survey.studies),
        "countries": studies.studies_per_country_year(survey.spatial, survey.studies),
        "speciation": studies.studies_per_speciation(survey.studies_all),
        "effort": studies.studies_per_effort(survey.studies_all),
        "table": studies.study_table(survey.studies),
        "short": studies.short_study_table(survey.studies),
        "text": studies.selected_studies_text(survey.studies, [2, 1]),
        "base": sites.base_layer(survey.spatial),
        "first": sites.distinct_sites(survey.spatial),
        "sites": sites.selected_site_layer(survey.spatial, survey.studies, range(1, 200), ["Ecology", "Zoonoses risk"]),
        "borders": sites.border_layer(survey.level_0, ["N1"]),
        "genera": species.genus_choices(survey.species),
        "species": species.species_choices(survey.species),
        "points": species.species_layer(survey.species, ["small ring", "red bolt", "blue bolt", "hot gear"]),
        "habitats": species.individuals_per_habitat(survey.rodent_summary),
        "groups": microbes.group_choices(survey.pathogen),
        "microbes": microbes.microbe_choices(survey.pathogen),
        "assays": microbes.assays_per_microbe(survey.pathogen),
        "detections": microbes.detection_layer(survey.pathogen),
        "clusters": microbes.detection_clusters(survey.pathogen, [4]),
        "associations": associations.host_pathogen_table(survey.pathogen, [host], ["All"]),
        "tested": associations.tested_per_country(survey.pathogen, survey.level_0, [1, 2, 3]),
    }
    for name, result in results.items():
        assert result.count() > 0, name
    assert "url" not in results["short"].columns and "title" not in results["short"].columns
    # The density table is computed once, stored, and drawn from storage.
    density = sites.site_density_by_region(survey.level_2, survey.spatial)
    density.write.parquet(f"{tmp_path}/density")
    stored = density.sparkSession.read.parquet(f"{tmp_path}/density")
    write_regions(sites.density_layer(stored), f"{tmp_path}/layer")
    assert density.sparkSession.read.parquet(f"{tmp_path}/layer").count() == 25
