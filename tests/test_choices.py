import pytest

from trapline.operators.choices import (
    filter_choice,
    filter_groups,
    filter_host_pathogen,
    filter_in,
    filter_not_contains,
    filter_reported,
    filter_selected,
    value_list,
    with_sentinel,
)
from trapline.functions.missing import ascending
from trapline.plans import microbes, species
from trapline.plans.studies import selected_studies_text


@pytest.fixture
def table(rows):
    data = [
        ("Rat", "Lassa", "Virus", "pcr_tested"),
        ("Rat", "Plague", "Bacteria", "pcr_positive"),
        ("Mouse", "Lassa", "Virus", None),
        ("Mouse", "Worm", "Helminth", "pcr_positive"),
        (None, None, None, "other"),
    ]
    return rows(data, "classification string, pathogen_clean string, pathogen_group string, assay string")


def names(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_membership_by_list_and_by_table(table, rows):
    assert filter_in(table, "classification", ["Rat"]).count() == 2
    assert filter_in(table, "classification", []).count() == 0
    keys = rows([("Rat",), ("Rat",), (None,)], "wanted string")
    assert filter_in(table, "classification", keys).count() == 3


def test_choice_is_switched_off_by_all_or_nothing(table):
    for values in (None, [], ["All"], ["Rat", "All"]):
        assert filter_choice(table, "classification", values).count() == 5
    assert filter_choice(table, "classification", ["Rat"]).count() == 2


def test_group_choice_falls_back_to_the_default_groups(table):
    for values in (None, [], ["All"]):
        assert filter_groups(table, "pathogen_group", values).count() == 3
    assert filter_groups(table, "pathogen_group", ["Helminth"]).count() == 1


def test_no_host_means_everything_whatever_the_pathogen(table):
    assert filter_host_pathogen(table, [], ["Lassa"]).count() == 5
    assert filter_host_pathogen(table, None, ["Lassa"]).count() == 5
    assert filter_host_pathogen(table, ["All"], ["All"]).count() == 5
    assert filter_host_pathogen(table, ["All"], ["Lassa"]).count() == 2
    assert filter_host_pathogen(table, ["Rat"], ["All"]).count() == 2
    assert filter_host_pathogen(table, ["Rat"], ["Lassa"]).count() == 1


def test_selection_has_no_sentinel(table):
    assert filter_selected(table, "classification", []).count() == 0
    assert filter_selected(table, "classification", None).count() == 0
    assert filter_selected(table, "classification", ["All"]).count() == 0
    assert filter_selected(table, "classification", ["Mouse"]).count() == 2


def test_text_filters(table):
    assert filter_not_contains(table, "assay", "tested").count() == 4
    assert filter_reported(table, "classification").count() == 4


def test_choice_list_starts_with_its_sentinel(table):
    choices = with_sentinel(
        table.select("classification").distinct(), ascending("classification"), "classification"
    )
    assert names(choices, "position", "choice") == [
        (0, "All"), (1, "Mouse"), (2, "Rat"), (3, None),
    ]
    assert value_list(choices.orderBy("position"), "choice") == ["All", "Mouse", "Rat", None]


def test_species_choices_follow_the_genus_and_count(rows):
    data = [("mus", "b"), ("mus", "b"), ("mus", "a"), ("rattus", "c"), ("mus", "c"), ("rattus", "c")]
    table = rows(data, "genus string, classification string")
    listed = species.species_choices(table, None, sentinel=None).orderBy("position")
    assert value_list(listed, "choice") == ["c", "b", "a"]
    chosen = species.species_choices(table, ["Mus"]).orderBy("position")
    assert value_list(chosen, "choice") == ["All", "b", "a", "c"]


def test_genus_choice_shows_a_shared_species_whole(rows):
    data = [
        ("mus", "shared_name", "farm"), ("rattus", "shared_name", "farm"),
        ("rattus", "other", "farm"), ("mus", "alone", "NA"),
    ]
    table = rows(data, "genus string, classification string, trap_habitat string")
    shown = species.individuals_per_habitat(table, ["Mus"])
    assert names(shown, "classification", "trap_habitat", "number") == [("Shared name", "Farm", 2)]


def test_microbe_rank_puts_unknown_medians_last(rows):
    data = [
        ("b", "x_tested", 1, "Virus"), ("b", "x_positive", 9, "Virus"),
        ("a", "x_tested", 50, "Virus"), ("z", "x_tested", None, "Virus"), (None, "x_tested", 3, "Virus"),
    ]
    table = rows(data, "pathogen_tested string, assay string, number bigint, pathogen_group string")
    out = microbes.assays_per_microbe(table, None)
    ranks = {r.pathogen_tested: r.level_rank for r in out.collect()}
    assert ranks == {"B": 1, "A": 2, "Z": 3, None: None}


def test_selected_ids_keep_the_order_of_selection(rows):
    table = rows([(f"s{i}",) for i in range(9)], "unique_id string")
    text = selected_studies_text(table, [5, 1, 3]).first()[0]
    assert text == "Selected studies:s4, s0, s2"
