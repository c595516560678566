"""Noise and prior of the models, and random ones for models of one's own."""

from __future__ import annotations

import numpy as np

from tidefold.errors import ParamError

# Means of the priors, by (dim_x, dim_y).
_MEANS = {
    (1, 1): [-0.45261100300789897, 0.4304857455543092],
    (2, 1): [-2.032552427456725, 1.4104234840116703, -0.047632237192333934],
    (2, 2): [-0.6574310585061062, 1.3924692044318112, -0.5062891144787869, 1.569949132247599],
    (3, 1): [1.3924692044318112, -0.5062891144787869, 1.569949132247599, -0.39836128088991196],
}

# Fixed values: (noise covariance, prior covariance) by (dim_x, dim_y, bound of the noise, bound of the prior), each as the rows of its upper triangle.
_COVARIANCES = {
    (1, 1, 0.1, 0.1): (
        [[0.007728597036828524, 0.0030944445015468544], [0.004294537672700443]],
        [[0.0025212335789608605, -0.0018825599961147382], [0.0022127018757407777]],
    ),
    (1, 1, 0.15, 0.15): (
        [[0.011592895555242785, 0.004641666752320285], [0.006441806509050664]],
        [[0.0037818503684412903, -0.0028238399941721073], [0.0033190528136111666]],
    ),
    (1, 1, 0.5, 0.5): (
        [[0.03864298518414261, 0.015472222507734279], [0.021472688363502215]],
        [[0.012606167894804302, -0.009412799980573691], [0.011063509378703889]],
    ),
    (1, 1, 0.9, 0.9): (
        [[0.0695573733314567, 0.027850000513921697], [0.03865083905430399]],
        [[0.022691102210647743, -0.016943039965032644], [0.019914316881667]],
    ),
    (2, 1, 0.1, 0.05): (
        [[0.009479563091456733, 0.00638411858990988, 0.0030944445015468544], [0.014711141077515243, 0.008326022487605365], [0.011421466989152218]],
        [[0.0067014743137328225, -0.0024313265236426285, 0.004269147790090194], [0.0073822895112209365, -0.002765947650325903], [0.007036095440416097]],
    ),
    (2, 1, 0.15, 0.15): (
        [[0.01450742458643089, 0.009864757834110605, 0.004641666752320285], [0.022354791565518648, 0.012489033731408042], [0.017131700483728328]],
        [[0.02032864794172642, -0.00752020457145584, 0.01280744337027058], [0.02237309353419076, -0.008297842950977708], [0.021106286321248287]],
    ),
    (2, 1, 0.5, 0.5): (
        [[0.05508928077050455, 0.03961605826277027, 0.015472222507734279], [0.0812471707007971, 0.04163011243802682], [0.0571033349457611]],
        [[0.07039911814524753, -0.027706640244345607, 0.04269147790090193], [0.07721627012012867, -0.027659476503259027], [0.07035195440416095]],
    ),
    (2, 2, 0.15, 0.15): (
        [[0.06917367350048753, -0.034134265980063416, 0.01621771421322981, 0.018820693307194304], [0.05826265792319365, -0.021303551948958124, -0.0028238399941721073], [0.037929725576576374, -0.0004074594143884413], [0.022052992715754855]],
        [[0.021552201676961383, 0.00972953106546073, 0.00936931113464276, 0.002452359476857891], [0.047238365335176585, 0.01904571936315992, -0.018462114906555936], [0.029832857537004532, 0.0014168270392018502], [0.022332301422615677]],
    ),
    (2, 2, 0.4, 0.4): (
        [[0.18684572066692476, -0.09340896727912712, 0.04324723790194615, 0.05018851548585149], [0.1577496791274744, -0.05680947186388833, -0.007530239984458953], [0.10295519893481894, -0.002897489168984472], [0.06061724463929491]],
        [[0.056919154569061846, 0.025393699605060098, 0.024984829692380695, 0.006539625271621052], [0.12541559099096905, 0.05078858496842646, -0.049232306417482496], [0.0858496291617981, 0.010075214500990939], [0.06584814619009449]],
    ),
    (2, 2, 1.0, 1.0): (
        [[0.48161143400571665, -0.24802105053622261, 0.10811809475486536, 0.12547128871462873], [0.4088713301570908, -0.14202367965972082, -0.018825599961147382], [0.2682520817207391, -0.01810930730615295], [0.16240719598192907]],
        [[0.13965635505634835, 0.060844217646344026, 0.062462074230951736, 0.016349063179052603], [0.31089744611111636, 0.12697146242106613, -0.12308076604370623], [0.25240462728321117, 0.06297009063119334], [0.20240091985395217]],
    ),
    (3, 1, 0.15, 0.15): (
        [[0.032358138142328324, 0.010418801684672248, 0.007139709526221969, 0.004641666752320285], [0.041717575850389814, 0.018808740434309523, 0.012489033731408042], [0.035672808292691933, 0.00972335833216044], [0.026855058815888767]],
        [[0.07502314399073153, 0.025590043577495496, 0.0275513656956253, 0.021880734717610727], [0.06407991227254797, 0.021260053180202063, 0.017228815514850407], [0.06738887120610368, 0.018576452330276307], [0.05768700256273744]],
    ),
    (3, 1, 0.35, 0.35): (
        [[0.0803347880516906, 0.028727642103387643, 0.01707468310829005, 0.010830555755413994], [0.1016248943577499, 0.043755173547743484, 0.02914107870661877], [0.08351869276440788, 0.022687836108374347], [0.0626604705704071]],
        [[0.17627967155920177, 0.06036088530974071, 0.06486273857503602, 0.05105504767442504], [0.14927336522802725, 0.048710910383635585, 0.04020056953465095], [0.156919704395983, 0.04334505543731138], [0.13460167264638737]],
    ),
}


def _symmetric(rows: list[list[float]]) -> np.ndarray:
    upper = np.array([[0.0] * (len(rows) - len(row)) + row for row in rows])
    return upper + np.triu(upper, 1).T


def random_covariance(n: int, bound: float, seed: int = 0) -> np.ndarray:
    """A covariance of n components whose largest value is bound: that of 2 n normal vectors."""
    if not bound > 0:
        raise ParamError(f"a covariance needs a bound above 0, not {bound}")
    v = np.random.default_rng(seed).standard_normal((n, 2 * n))
    m = v @ v.T
    return m * (bound / np.abs(m).max())


def model_covariances(dim_x: int, dim_y: int, bound: float, prior_bound: float | None = None, seed: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(noise covariance, prior mean, prior covariance): the fixed ones of the library's models; with a seed random ones within the bounds.

    Without a seed, sizes and bounds that no model of the library has are an error.
    """
    prior_bound = bound if prior_bound is None else prior_bound
    if seed is None:
        fixed = _COVARIANCES.get((dim_x, dim_y, bound, prior_bound))
        if not fixed:
            raise ParamError(f"there are no fixed covariances of {dim_x} states and {dim_y} observations within {bound} and {prior_bound}; give a seed for random ones")
        return _symmetric(fixed[0]), np.array(_MEANS[dim_x, dim_y]), _symmetric(fixed[1])
    n = dim_x + dim_y
    return random_covariance(n, bound, seed), np.random.default_rng(seed + 1).standard_normal(n), random_covariance(n, prior_bound, seed + 2)
