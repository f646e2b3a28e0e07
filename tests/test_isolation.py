"""Modules of the suite share one session, but no cached frames (``test_cube`` runs before this one and caches some)."""


def test_no_frame_of_an_earlier_module_is_cached(spark):
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
