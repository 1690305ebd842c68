"""Density queries over possession points of the match-event view E."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import density as D
from touchline.operators.events import possession_points
from touchline.plans.q_events import POSSESSION_SQL
from touchline.plans.registry import register
from touchline.sources import views as V


def pts(spark, sf):
    return possession_points(V.match_events(spark, sf))


K1_SQL = f"""WITH pp AS ({POSSESSION_SQL}),
g AS (SELECT team, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y, var_pop(x) + 1e-6 AS vx, covar_pop(x, y) AS cxy,
   var_pop(y) + 1e-6 AS vy, var_pop(x) AS sxx, var_pop(y) AS syy FROM pp GROUP BY team),
l AS (SELECT *, vx * vy - cxy * cxy AS det FROM g),
m AS (SELECT *, -n / 2.0 * (2 * ln(2 * pi()) + ln(det) + (vy * sxx - 2 * cxy * cxy + vx * syy) / det) AS ll FROM l)"""


@register("gaussian_k1", K1_SQL + """ SELECT team, n, mean_x, mean_y, vx AS var_x, cxy AS cov_xy, vy AS var_y,
  ll AS log_likelihood, -2 * ll + 5 * ln(n) AS bic FROM m""", views=("match_events",),
          dbl=("mean_x", "mean_y", "var_x", "cov_xy", "var_y", "log_likelihood", "bic"))
def q_gaussian_k1(spark, sf):
    """ML14 k = 1: closed-form Gaussian of each team's possession points."""
    return D.gaussian_k1(pts(spark, sf), ["team"])


COMP_SQL = K1_SQL + """, comps AS (SELECT team AS component, CAST(n AS DOUBLE) / sum(n) OVER () AS weight, mean_x, mean_y,
  vx AS var_x, cxy AS cov_xy, vy AS var_y FROM m)"""


def comps(spark, sf):
    return D.mixture_from_groups(D.gaussian_k1(pts(spark, sf), ["team"]), "team")


GRID_SQL = """grid AS (SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy,
  CASE WHEN ix = 119 THEN 120.0 ELSE ix * (120.0 / 119) END AS gx,
  CASE WHEN iy = 79 THEN 80.0 ELSE iy * (80.0 / 79) END AS gy FROM range(120) a(ix), range(80) b(iy))"""


@register("gmm_pdf_grid", COMP_SQL + ", " + GRID_SQL + """
SELECT ix, iy, gx, gy, sum(weight * exp(-0.5 * (var_y * (gx - mean_x) * (gx - mean_x) - 2 * cov_xy * (gx - mean_x) * (gy - mean_y)
  + var_x * (gy - mean_y) * (gy - mean_y)) / (var_x * var_y - cov_xy * cov_xy))
  / (2 * pi() * sqrt(var_x * var_y - cov_xy * cov_xy))) AS density FROM grid, comps GROUP BY 1, 2, 3, 4""",
          views=("match_events",), dbl=("gx", "gy", "density"), digits=12)
def q_gmm_pdf_grid(spark, sf):
    """ML15/JN7: mixture of the two teams' Gaussians evaluated on the 120×80 pitch grid."""
    return D.mixture_density(D.pitch_grid(spark), comps(spark, sf))


@register("gmm_ellipses", COMP_SQL + """ SELECT component, mean_x, mean_y,
  2 * sqrt((var_x + var_y) / 2.0 + sqrt(((var_x - var_y) / 2.0) * ((var_x - var_y) / 2.0) + cov_xy * cov_xy)) AS width,
  2 * sqrt((var_x + var_y) / 2.0 - sqrt(((var_x - var_y) / 2.0) * ((var_x - var_y) / 2.0) + cov_xy * cov_xy)) AS height,
  degrees(atan2(cov_xy, (var_x + var_y) / 2.0 + sqrt(((var_x - var_y) / 2.0) * ((var_x - var_y) / 2.0) + cov_xy * cov_xy)
  - var_y)) AS angle_deg FROM comps""", views=("match_events",),
          dbl=("mean_x", "mean_y", "width", "height", "angle_deg"))
def q_gmm_ellipses(spark, sf):
    return D.ellipses(comps(spark, sf))


@register("kde_grid", f"""WITH pp AS ({POSSESSION_SQL}),
s AS (SELECT count(*) AS n, var_samp(x) * pow(count(*), -1.0/3.0) AS hx, covar_samp(x, y) * pow(count(*), -1.0/3.0) AS hxy,
   var_samp(y) * pow(count(*), -1.0/3.0) AS hy FROM pp),
d AS (SELECT x AS px, y AS py, count(*) AS c FROM pp GROUP BY 1, 2), {GRID_SQL}
SELECT ix, iy, gx, gy, sum(c * exp(-0.5 * (hy * (gx - px) * (gx - px) - 2 * hxy * (gx - px) * (gy - py)
  + hx * (gy - py) * (gy - py)) / (hx * hy - hxy * hxy)) / (2 * pi() * sqrt(hx * hy - hxy * hxy)) / n) AS density
FROM grid, d, s GROUP BY 1, 2, 3, 4""", views=("match_events",), dbl=("gx", "gy", "density"), digits=12)
def q_kde_grid(spark, sf):
    """JN8: kernel density of all possession points on the pitch grid."""
    return D.kde_grid(pts(spark, sf))


@register("gmm_fit")
def q_gmm_fit(spark, sf):
    """ML14: MLlib mixture (k = 4) of possession points; component table."""
    model, _ = D.fit_gmm(pts(spark, sf), 4, seed=42)
    return D.gmm_components(model)


@register("gmm_bic")
def q_gmm_bic(spark, sf):
    """ML14/TOP6: BIC over k = 1…49."""
    return D.gmm_bic_curve(pts(spark, sf), list(range(1, 50)), seed=42, parallelism=8)


@register("gmm_sample")
def q_gmm_sample(spark, sf):
    """ML17: 1000 seeded draws from the two-team mixture."""
    return D.gmm_sample(spark, comps(spark, sf), 1000, seed=42)
