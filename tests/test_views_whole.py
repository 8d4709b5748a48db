"""Stored events and links come from whole tables."""

from tidewire.plans.views import view
from tidewire.runtime import table


def test_events_and_links_are_all_there(spark, sf_dir):
    assert view(spark, sf_dir, "v_event").count() == table(spark, sf_dir, "orders").count()
    assert view(spark, sf_dir, "v_link").count() == table(spark, sf_dir, "lineitem").count()
