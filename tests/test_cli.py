from mosaiq.cli import parser


def test_cluster_takes_all_points_by_default():
    assert parser().parse_args(["cluster", "--points", "x"]).max_points is None
    assert parser().parse_args(["cluster", "--points", "x", "--max-points", "7"]).max_points == 7
