"""Images of a table that is one small file are worked on by many tasks."""

from __future__ import annotations

import numpy as np
import pytest

from vellum.operators import masks as M
from vellum.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["G35_borders", "K15_contour_boxes", "K1_crops", "K2_flood_area", "K3_eroded_area", "K4_single_bubble", "K6_labelled_components", "K7_complete_mask"])
def test_images_are_dealt_out(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= 16


def test_long_paths_take_few_steps():
    """A snake through the mask is one component, though its path has half of the mask's pixels."""
    mask = np.zeros((401, 400), bool)
    mask[::2] = True
    mask[1::4, -1] = mask[3::4, 0] = True
    assert (M.flooded(mask, 0, 0) == mask).all()
    assert (M.labelled(mask) == mask).all()
    assert M.extents(M.labelled(mask)) == [(int(mask.sum()), 0, 0, 400, 401)]
    spots = np.zeros((6, 6), bool)
    spots[::2, ::2] = True
    assert M.labelled(spots).max() == 9 and M.flooded(spots, 1, 1).sum() == 0 and M.flooded(spots, 2, 2).sum() == 1


@pytest.mark.parametrize("name", ["W12_tile_plan", "W13_reassembly"])
def test_tiles_of_images_are_dealt_out_and_laid_without_a_shuffle_of_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of the images
    assert df.rdd.getNumPartitions() >= 16
