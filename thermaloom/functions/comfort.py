"""Thermal comfort: UTCI, moist thermodynamics, wet bulb, black globe, WBGT."""

from __future__ import annotations

from thermaloom.functions.formula import by_itself, horner, Step

# Coefficients of the sixth-order UTCI regression (Broede et al. 2012), for the
# monomials Pa^l * dT^k * va^j * Ta^i with l + k + j + i <= 6, in the order l, k, j, i, i running fastest.
UTCI_COEFFICIENTS = (
    6.07562052e-01, -2.27712343e-02, 8.06470249e-04, -1.54271372e-04, -3.24651735e-06, 7.32602852e-08,
    1.35959073e-09, -2.25836520e+00, 8.80326035e-02, 2.16844454e-03, -1.53347087e-05, -5.72983704e-07,
    -2.55090145e-09, -7.51269505e-01, -4.08350271e-03, -5.21670675e-05, 1.94544667e-06, 1.14099531e-08,
    1.58137256e-01, -6.57263143e-05, 2.22697524e-07, -4.16117031e-08, -1.27762753e-02, 9.66891875e-06,
    2.52785852e-09, 4.56306672e-04, -1.74202546e-07, -5.91491269e-06, 3.98374029e-01, 1.83945314e-04,
    -1.73754510e-04, -7.60781159e-07, 3.77830287e-08, 5.43079673e-10, -2.00518269e-02, 8.92859837e-04,
    3.45433048e-06, -3.77925774e-07, -1.69699377e-09, 1.69992415e-04, -4.99204314e-05, 2.47417178e-07,
    1.07596466e-08, 8.49242932e-05, 1.35191328e-06, -6.21531254e-09, -4.99410301e-06, -1.89489258e-08,
    8.15300114e-08, 7.55043090e-04, -5.65095215e-05, -4.52166564e-07, 2.46688878e-08, 2.42674348e-10,
    1.54547250e-04, 5.24110970e-06, -8.75874982e-08, -1.50743064e-09, -1.56236307e-05, -1.33895614e-07,
    2.49709824e-09, 6.51711721e-07, 1.94960053e-09, -1.00361113e-08, -1.21206673e-05, -2.18203660e-07,
    7.51269482e-09, 9.79063848e-11, 1.25006734e-06, -1.81584736e-09, -3.52197671e-10, -3.36514630e-08,
    1.35908359e-10, 4.17032620e-10, -1.30369025e-09, 4.13908461e-10, 9.22652254e-12, -5.08220384e-09,
    -2.24730961e-11, 1.17139133e-10, 6.62154879e-10, 4.03863260e-13, 1.95087203e-12, -4.73602469e-12,
    5.12733497e+00, -3.12788561e-01, -1.96701861e-02, 9.99690870e-04, 9.51738512e-06, -4.66426341e-07,
    5.48050612e-01, -3.30552823e-03, -1.64119440e-03, -5.16670694e-06, 9.52692432e-07, -4.29223622e-02,
    5.00845667e-03, 1.00601257e-06, -1.81748644e-06, -1.25813502e-03, -1.79330391e-04, 2.34994441e-06,
    1.29735808e-04, 1.29064870e-06, -2.28558686e-06, -3.69476348e-02, 1.62325322e-03, -3.14279680e-05,
    2.59835559e-06, -4.77136523e-08, 8.64203390e-03, -6.87405181e-04, -9.13863872e-06, 5.15916806e-07,
    -3.59217476e-05, 3.28696511e-05, -7.10542454e-07, -1.24382300e-05, -7.38584400e-09, 2.20609296e-07,
    -7.32469180e-04, -1.87381964e-05, 4.80925239e-06, -8.75492040e-08, 2.77862930e-05, -5.06004592e-06,
    1.14325367e-07, 2.53016723e-06, -1.72857035e-08, -3.95079398e-08, -3.59413173e-07, 7.04388046e-07,
    -1.89309167e-08, -4.79768731e-07, 7.96079978e-09, 1.62897058e-09, 3.94367674e-08, -1.18566247e-09,
    3.34678041e-10, -1.15606447e-10, -2.80626406e+00, 5.48712484e-01, -3.99428410e-03, -9.54009191e-04,
    1.93090978e-05, -3.08806365e-01, 1.16952364e-02, 4.95271903e-04, -1.90710882e-05, 2.10787756e-03,
    -6.98445738e-04, 2.30109073e-05, 4.17856590e-04, -1.27043871e-05, -3.04620472e-06, 5.14507424e-02,
    -4.32510997e-03, 8.99281156e-05, -7.14663943e-07, -2.66016305e-04, 2.63789586e-04, -7.01199003e-06,
    -1.06823306e-04, 3.61341136e-06, 2.29748967e-07, 3.04788893e-04, -6.42070836e-05, 1.16257971e-06,
    7.68023384e-06, -5.47446896e-07, -3.59937910e-08, -4.36497725e-06, 1.68737969e-07, 2.67489271e-08,
    3.23926897e-09, -3.53874123e-02, -2.21201190e-01, 1.55126038e-02, -2.63917279e-04, 4.53433455e-02,
    -4.32943862e-03, 1.45389826e-04, 2.17508610e-04, -6.66724702e-05, 3.33217140e-05, -2.26921615e-03,
    3.80261982e-04, -5.45314314e-09, -7.96355448e-04, 2.53458034e-05, -6.31223658e-06, 3.02122035e-04,
    -4.77403547e-06, 1.73825715e-06, -4.09087898e-07, 6.14155345e-01, -6.16755931e-02, 1.33374846e-03,
    3.55375387e-03, -5.13027851e-04, 1.02449757e-04, -1.48526421e-03, -4.11469183e-05, -6.80434415e-06,
    -9.77675906e-06, 8.82773108e-02, -3.01859306e-03, 1.04452989e-03, 2.47090539e-04, 1.48348065e-03,
)
# Coefficients of the saturation pressure over water used by UTCI (Hardy 1998).
UTCI_SATURATION = (-2.8365744e3, -6.028076559e3, 1.954263612e1, -2.737830188e-2, 1.6261698e-5, 7.0229056e-10, -1.8680009e-13, 2.7150305)
#: Lower bounds of the UTCI stress classes, warmest first, and the class below all.
UTCI_CLASSES = ((46.0, "extreme heat stress"), (38.0, "very strong heat stress"), (32.0, "strong heat stress"), (26.0, "moderate heat stress"), (9.0, "no thermal stress"), (0.0, "slight cold stress"), (-13.0, "moderate cold stress"), (-27.0, "strong cold stress"), (-40.0, "very strong cold stress"))
COLDEST_CLASS = "extreme cold stress"

# Thermodynamic constants.
RD, RV, CPD, CPV, CPL, CPI = 287.0, 461.5, 1005.0, 2040.0, 4220.0, 2097.0
T0, ES0, LV0, LF0 = 273.16, 611.657, 2.501e6, 0.333e6
LS0, EPS = LV0 + LF0, RD / RV
T_LIQUID, T_ICE = 273.15, 253.15


def utci_polynomial(ta: str = "ta", dt: str = "d_tmrt", va: str = "va", pa: str = "pa") -> str:
    """Nested Horner form over the four variables, generated from the coefficient order."""
    at = iter(UTCI_COEFFICIENTS)
    by_pa = []
    for l in range(7):
        by_dt = []
        for k in range(7 - l):
            by_va = []
            for j in range(7 - l - k):
                by_va.append(horner(ta, [f"({next(at)!r})" for _ in range(7 - l - k - j)]))
            part = horner(va, by_va)
            by_dt.append(by_itself(part) if len(by_va) > 1 else part)
        by_pa.append(horner(dt, by_dt))
    return f"{ta} + {horner(pa, by_pa)}"


def utci_saturation(tk: str = "tk") -> str:
    """Saturation pressure in hPa from kelvin."""
    g = UTCI_SATURATION
    powers = " + ".join(f"({c!r}) * pow({tk}, {i - 2}.0)" for i, c in enumerate(g[:7]))
    return f"0.01 * exp(({g[7]!r}) * ln({tk}) + {powers})"


#: From ta, rh (percent), tmrt, va: vapour pressure in kPa and UTCI; null in, null out.
UTCI: list[Step] = [
    ("tk", "ta + 273.15"),
    ("pa", f"{utci_saturation()} * rh / 1000.0"),
    ("d_tmrt", "tmrt - ta"),
    ("utci", utci_polynomial()),
]


def utci_class(utci: str = "utci") -> str:
    whens = " ".join(f"when {utci} >= {bound} then '{name}'" for bound, name in UTCI_CLASSES)
    return f"case when {utci} is null then null {whens} else '{COLDEST_CLASS}' end"


def latent_heat(t: str, l0: str, cp: str) -> str:
    return f"(({l0}) + ({CPV} - ({cp})) * (({t}) - {T0}))"


def saturation_pressure(t: str, phase: str = "liquid", omega: str = "0.0") -> str:
    """Pa, over liquid, ice, or a mixture with ice fraction omega."""
    cp, l0 = {"liquid": (f"{CPL}", f"{LV0}"), "ice": (f"{CPI}", f"{LS0}"), "mixed": (f"((1.0 - ({omega})) * {CPL} + ({omega}) * {CPI})", f"((1.0 - ({omega})) * {LV0} + ({omega}) * {LS0})")}[phase]
    return f"{ES0} * pow({T0} / ({t}), (({cp}) - {CPV}) / {RV}) * exp(({l0}) / ({RV} * {T0}) - {latent_heat(t, l0, cp)} / ({RV} * ({t})))"


def ice_fraction(t: str) -> str:
    return f"case when {t} <= {T_ICE} then 1.0 when {t} >= {T_LIQUID} then 0.0 else 0.5 * (1.0 - cos(pi() * ({T_LIQUID} - {t}) / ({T_LIQUID} - {T_ICE}))) end"


def specific_humidity(p: str, e: str) -> str:
    """From pressure and vapour pressure, both in Pa."""
    return f"({EPS!r} * ({e}) / (({p}) - (1.0 - {EPS!r}) * ({e})))"


def _ratio(x: str, top: list[float], bottom: list[float]) -> str:
    return f"({x} * {horner(x, [repr(c) for c in top])}) / {horner(x, ['1.0', *(repr(c) for c in bottom)])}"


def lambert_w1(x: str) -> list[Step]:
    """Lower real branch of Lambert's W on [-1/e, 0): three rational pieces and one Fritsch step."""
    # Rational approximations of the branch.
    near = _ratio(x, [-7.874564067684664, -63.11879948166995, -168.6110850408981, -150.1089086912451], [15.97679839497612, 98.26612857148953, 293.9558944644677, 430.4471947824411, 247.8576700279611])
    middle = _ratio(x, [-1362.78381643109, -1386.04132570149, 11892.1649836015, 16904.0507511421], [251.440197724561, -1264.99554712435, -5687.63429510978, -2639.24130979048])
    far = _ratio(x, [1.01999365162218, -12.6917365519443, -45.1506015092455], [-22.9809693297808, -104.692066099727, -95.2085341727207])
    return [
        ("w_log", f"case when {x} >= -0.1 and {x} < 0 then ln(-{x}) end"),
        ("w_raw", f"case when {x} < -0.36787944117144233 or {x} >= 0 then null when {x} < -0.34 then ({near}) * ({x} + exp(-1.0)) - 1.0 when {x} < -0.1 then {middle} else {far} + w_log - ln(-w_log) + ln(-w_log) / w_log end"),
        ("w_z", f"case when {x} / w_raw > 0 then ln({x} / w_raw) - w_raw end"),
        ("w_t", "2.0 * (1.0 + w_raw) * (1.0 + w_raw + 2.0 / 3.0 * w_z)"),
        ("w", "case when abs(1.0 + w_raw) < 1e-12 then w_raw else w_raw * (1.0 + w_z / (1.0 + w_raw) * (w_t - w_z) / (w_t - 2.0 * w_z)) end"),
    ]


def dew_point(phase: str = "liquid") -> list[Step]:
    """Dew (or frost) point in kelvin from t_k and rh_part (0..1 of saturation over the phase), not above t_k."""
    cp, l0 = (CPL, LV0) if phase == "liquid" else (CPI, LS0)
    beta = (cp - CPV) / RV
    alpha = -(1 / beta) * (l0 + (cp - CPV) * T0) / RV
    return [
        ("td_x", f"case when rh_part > 0 then pow(rh_part, {1 / beta!r}) * ({alpha!r} / t_k) * exp({alpha!r} / t_k) end"),
        *lambert_w1("td_x"),
        ("td_k", f"least({alpha!r} / w, t_k)"),
    ]


def wet_bulb(iterations: int = 8) -> list[Step]:
    """Isobaric wet bulb over liquid in kelvin from p_pa, t_k, q, td_k: Newton steps on the moist enthalpy balance, from the one-third rule."""
    steps: list[Step] = [("cpm", f"(1.0 - q) * {CPD} + q * {CPV}"), ("tw_0", "t_k - (t_k - td_k) / 3.0")]
    for i in range(iterations):
        t = f"tw_{i}"
        steps += [
            (f"es_{i}", saturation_pressure(t)),
            (f"qs_{i}", f"{EPS!r} * es_{i} / (p_pa - (1.0 - {EPS!r}) * es_{i})"),
            (f"lv_{i}", latent_heat(t, f"{LV0}", f"{CPL}")),
            (f"dq_{i}", f"qs_{i} * (1.0 - qs_{i} + qs_{i} / {EPS!r}) * lv_{i} / ({RV} * {t} * {t})"),
            (f"tw_{i + 1}", f"{t} + (cpm * (t_k - {t}) * (1.0 - qs_{i}) - (qs_{i} - q) * lv_{i}) / ((cpm * (t_k - {t}) + lv_{i}) * dq_{i} + cpm * (1.0 - qs_{i}) + (qs_{i} - q) * ({CPV} - {CPL}))"),
        ]
    return [*steps, ("tw_k", f"least(t_k, tw_{iterations})")]


#: Black-globe temperature from tmrt, ta and va: the quartic of the globe's balance in closed form.
GLOBE: list[Step] = [
    ("hc", "6.3 / 0.46821 * pow(va, 0.6)"),
    ("bg_a", "hc / (0.95 * 5.670374419e-8)"),
    ("bg_b", "pow(tmrt + 273.15, 4.0) + bg_a * (ta + 273.15)"),
    ("bg_e", "pow(9.0 * bg_a * bg_a + 1.73205 * sqrt(27.0 * pow(bg_a, 4.0) + 256.0 * pow(bg_b, 3.0)), 1.0 / 3.0)"),
    ("bg_k", "0.381571 * bg_e - 3.4943 * bg_b / bg_e"),
    ("globe", "0.5 * sqrt(greatest(2.0 * bg_a / sqrt(greatest(bg_k, 1e-30)) - bg_k, 0.0)) - 0.5 * sqrt(greatest(bg_k, 0.0)) - 273.15"),
]


def wbgt(shaded: str = "lit < 0.1") -> str:
    """From tw_c, globe, ta. By default cells whose ``lit`` is below 0.1 get the formula without the air temperature; pass the opposite condition to swap."""
    return f"case when {shaded} then 0.7 * tw_c + 0.3 * globe else 0.7 * tw_c + 0.2 * globe + 0.1 * ta end"
