"""Stages live in the application's own folder and can be cleared."""

import os

from quillsift.session import clear_stages, materialise, stage_dir


def test_stages_are_kept_until_cleared(spark):
    staged = materialise(spark.range(5))
    folder = stage_dir(spark).removeprefix("file:")
    assert staged.count() == 5 and os.listdir(folder)
    clear_stages(spark)
    assert not os.path.exists(folder)
    assert materialise(spark.range(3)).count() == 3
