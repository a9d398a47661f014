"""The reader of array files against files written here, byte by byte, from the format's published grammar."""

import struct

import numpy as np
import pytest

from halocline.sources import arrays as A

CODES = {"i1": 1, "S1": 2, ">i2": 3, ">i4": 4, ">f4": 5, ">f8": 6}


def classic(dims, variables, version=1, streamed=False):
    """dims {name: length, None for records}; variables {name: (dims, dtype, values, attributes)}."""
    count, offset = (">Q" if version == 5 else ">I"), (">I" if version == 1 else ">Q")
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda x: struct.pack(count, len(x)) + pad(x.encode())

    def attributes(found):
        out = struct.pack(">I", 12 if found else 0) + struct.pack(count, len(found))
        for k, x in found.items():
            code, raw, n = (2, x.encode(), len(x)) if isinstance(x, str) else (6, struct.pack(">d", x), 1)
            out += name(k) + struct.pack(">I", code) + struct.pack(count, n) + pad(raw)
        return out

    data = {k: np.asarray(v[2], v[1]) for k, v in variables.items()}
    rolling = [k for k, v in variables.items() if v[0] and dims[v[0][0]] is None]
    records = len(data[rolling[0]]) if rolling else 0
    order, begins = list(dims), {}

    def head():
        out = b"CDF" + bytes([version]) + struct.pack(count, (1 << (64 if version == 5 else 32)) - 1 if streamed else records)
        out += struct.pack(">I", 10 if dims else 0) + struct.pack(count, len(dims)) + b"".join(name(k) + struct.pack(count, n or 0) for k, n in dims.items())
        out += attributes({"title": "x"}) + struct.pack(">I", 11) + struct.pack(count, len(variables))
        for k, (on, kind, _, found) in variables.items():
            out += name(k) + struct.pack(count, len(on)) + b"".join(struct.pack(count, order.index(d)) for d in on) + attributes(found)
            out += struct.pack(">I", CODES[kind]) + struct.pack(count, 0) + struct.pack(offset, begins.get(k, 0))
        return out

    at, body = len(head()), b""
    for k in variables:
        if k not in rolling:
            begins[k] = at + len(body)
            body += pad(data[k].tobytes())
    fit = (lambda b: b) if len(rolling) == 1 else pad
    first = b""
    for k in rolling:
        begins[k] = at + len(body) + len(first)
        first += fit(data[k][:1].tobytes())
    return head() + body + b"".join(fit(data[k][r : r + 1].tobytes()) for r in range(records) for k in rolling)


def saved(tmp_path, data, name="a.nc"):
    (tmp_path / name).write_bytes(data)
    return f"file://{tmp_path}/*.nc"


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("streamed", [False, True])
def test_records_fixed_parts_fills_scales_and_times(version, streamed):
    found = A.ArrayFile(classic({"time": None, "x": 3}, {
        "x": (("x",), ">f4", [1.5, 2.5, 3.5], {}),
        "time": (("time",), ">f8", [0.0, 1.5], {"units": "days since 1950-01-01 06:00:00"}),
        "v": (("time", "x"), ">i2", [[1, 2, -9], [4, 5, 6]], {"_FillValue": -9.0, "scale_factor": 0.5, "add_offset": 10.0}),
    }, version, streamed))
    assert found.dims == {"time": 2, "x": 3} and found.attributes == {"title": "x"}
    np.testing.assert_array_equal(found.numbers("v"), [[10.5, 11, np.nan], [12, 12.5, 13]])
    np.testing.assert_array_equal(found.numbers("x"), [1.5, 2.5, 3.5])
    base = np.datetime64("1950-01-01T06", "us").astype(int)
    np.testing.assert_array_equal(found.micros("time"), [base, base + 129600 * 10**6])


def test_a_lone_record_variable_has_no_padding():
    found = A.ArrayFile(classic({"t": None, "x": 3}, {"v": (("t", "x"), ">i2", [[1, 2, 3], [4, 5, 6], [7, 8, 9]], {})}))
    np.testing.assert_array_equal(found.numbers("v"), [[1, 2, 3], [4, 5, 6], [7, 8, 9]])


def test_other_bytes_are_refused():
    with pytest.raises(ValueError, match="classic"):
        A.ArrayFile(b"\x89HDF\r\n\x1a\n")


def test_sigma_model(spark, tmp_path):
    dims = {"time": None, "s_rho": 2, "eta": 2, "xi": 2}
    temp = np.arange(16.0).reshape(2, 2, 2, 2)
    path = saved(tmp_path, classic(dims, {
        "time": (("time",), ">f8", [0, 1], {"units": "hours since 2000-01-01"}),
        "temp": (("time", "s_rho", "eta", "xi"), ">f8", temp, {}),
        "zeta": (("time", "eta", "xi"), ">f8", np.full((2, 2, 2), 0.5), {}),
        "h": (("eta", "xi"), ">f8", [[100, 200], [300, 400]], {}),
        "mask_rho": (("eta", "xi"), ">f8", [[1, 0], [1, 1]], {}),
        "lon_rho": (("eta", "xi"), ">f8", [[1, 2], [1, 2]], {}), "lat_rho": (("eta", "xi"), ">f8", [[5, 5], [6, 6]], {}),
        "sc_r": (("s_rho",), ">f8", [-0.75, -0.25], {}), "Cs_r": (("s_rho",), ">f8", [-0.6, -0.1], {}),
    }))
    rows = {(r.t, r.k, r.j, r.i): r for r in A.sigma_depths(A.sigma_field(spark, path, "temperature"), hc=50.0).collect()}
    assert len(rows) == 16
    for (t, k, j, i), r in rows.items():
        assert r.value == (None if (j, i) == (0, 1) else temp[t, k, j, i])
        h, sc, cs = [[100, 200], [300, 400]][j][i], [-0.75, -0.25][k], [-0.6, -0.1][k]
        s = (50 * sc + h * cs) / (50 + h)
        assert r.z == pytest.approx(0.5 * (1 + s) + h * s) and (r.lon, r.lat) == (i + 1, j + 5)
        assert str(r.time) == f"2000-01-01 0{t}:00:00"
    ssh = A.sigma_field(spark, path, "ssh", apply_mask=False).collect()
    assert len(ssh) == 8 and {r.value for r in ssh} == {0.5} and {r.k for r in ssh} == {0}


def test_level_model_surface_takes_the_first_level_of_a_mask(spark, tmp_path):
    path = saved(tmp_path, classic({"t": 1, "depth": 2, "y": 1, "x": 2}, {
        "zos": (("t", "y", "x"), ">f4", [[[1, 2]]], {}), "so": (("t", "depth", "y", "x"), ">f4", [[[[1, 2]], [[3, 4]]]], {}),
        "depth": (("depth",), ">f4", [5, 10], {}), "tmask": (("depth", "y", "x"), "i1", [[[1, 0]], [[0, 0]]], {}),
    }))
    assert [r.value for r in A.level_field(spark, path, "ssh").orderBy("i").collect()] == [1.0, None]
    found = A.level_field(spark, path, "salinity").orderBy("k", "i").collect()
    assert [(r.value, r.z, r.time) for r in found] == [(1.0, -5.0, None), (None, -5.0, None), (None, -10.0, None), (None, -10.0, None)]
    with pytest.raises(Exception, match="has none of"):
        A.level_field(spark, path, "temperature").collect()


def test_products_boxes_kelvin_and_swaths(spark, tmp_path):
    path = saved(tmp_path, classic({"time": 1, "lat": 2, "lon": 2}, {
        "time": (("time",), ">i4", [10], {"units": "seconds since 1981-01-01 00:00:00"}), "lat": (("lat",), ">f4", [20, 60], {}), "lon": (("lon",), ">f4", [-87, -86], {}),
        "analysed_sst": (("time", "lat", "lon"), ">i2", [[[300, 301], [302, -99]]], {"_FillValue": -99.0}), "adt": (("lat", "lon"), ">f8", [[1, np.nan], [3, 4]], {}),
    }))
    warm = A.celsius(A.product(spark, path, "sst", region="yucatan")).orderBy("i").collect()
    assert [r.sst for r in warm] == pytest.approx([26.85, 27.85]) and str(warm[0].time) == "1981-01-01 00:00:10"
    assert sorted(A.swath_points(spark, path).collect()) == [(-87.0, 20.0, 1.0), (-87.0, 60.0, 3.0), (-86.0, 60.0, 4.0)]
    whole = A.product(spark, path, "sst").where("sst IS NULL").collect()
    assert len(whole) == 1 and whole[0].lat == 60


def test_float_profiles(spark, tmp_path):
    path = saved(tmp_path, classic({"N_PROF": 2, "N_LEVELS": 2}, {
        "JULD": (("N_PROF",), ">f8", [0, 400], {"units": "days since 1950-01-01 00:00:00"}), "LONGITUDE": (("N_PROF",), ">f8", [-90, 10], {}), "LATITUDE": (("N_PROF",), ">f8", [25, 25], {}),
        "TEMP": (("N_PROF", "N_LEVELS"), ">f4", [[10, 11], [12, 13]], {}), "TEMP_QC": (("N_PROF", "N_LEVELS"), "S1", [[b"1", b"4"], [b"2", b" "]], {}),
        "PRES": (("N_PROF", "N_LEVELS"), ">f4", [[5, 6], [7, 8]], {}),
    }))
    found = A.float_profiles(spark, path).orderBy("profile", "level").collect()
    assert [(r.profile, r.level, r.temperature, r.salinity, r.pressure) for r in found] == [(0, 0, 10.0, None, 5.0), (1, 0, 12.0, None, 7.0)]
    assert A.float_profiles(spark, path, good_qc=False).count() == 4
    assert A.float_profiles(spark, path, bbox=(-98, 16, -80, 31)).count() == 1
    assert A.float_profiles(spark, path, good_qc=False, dates=("1950-01-01", "1950-12-31")).count() == 2


def test_stations_and_gliders(spark, tmp_path):
    path = saved(tmp_path, classic({"time": 2, "depth": 2}, {
        "time": (("time",), ">f8", [0, 1], {"units": "days since 2000-01-01"}), "depth": (("depth",), ">f4", [10, 20], {}), "u": (("time", "depth"), ">f4", [[1, 2], [3, 4]], {}),
        "v": (("time", "depth"), ">f4", [[5, 6], [7, 8]], {}), "tau": (("time",), ">f8", [1.25, 1.5], {}),
    }))
    found = A.station_series(spark, path, "currents").orderBy("t", "k").collect()
    assert [(r.t, r.depth, r.u, r.v) for r in found] == [(0, 10, 1, 5), (0, 20, 2, 6), (1, 10, 3, 7), (1, 20, 4, 8)]
    assert [r.tau for r in A.station_series(spark, path, "echo").orderBy("t").collect()] == [1.25, 1.5]
    other = tmp_path / "g"
    other.mkdir()
    path = saved(other, classic({"n": 3}, {
        "TIME": (("n",), ">f8", [0, 1, 2], {"units": "hours since 2000-01-01"}), "LONGITUDE": (("n",), ">f8", [1, 2, 3], {}), "LATITUDE": (("n",), ">f8", [4, 5, 6], {}),
        "PRES": (("n",), ">f8", [0, 50, 100], {}), "PROFILE_NUMBER": (("n",), ">i4", [1, 1, 2], {}),
    }))
    samples = A.glider_path(spark, path, pressures=(0, 60))
    assert [(r.profile, r.lon, r.n) for r in A.glider_profiles(samples).collect()] == [(1.0, 1.0, 2)]
    assert A.glider_profiles(A.glider_path(spark, path)).count() == 2


def test_many_files_and_batches(spark, tmp_path):
    path = saved(tmp_path, classic({"time": 100_000}, {"tau": (("time",), ">f8", np.arange(1e5), {})}), "a.nc")
    saved(tmp_path, classic({"time": 1}, {"tau": (("time",), ">f8", [7], {})}), "c.nc")
    found = A.station_series(spark, path, "echo")
    assert found.count() == 100_001 and found.selectExpr("sum(tau)", "count(distinct file)").first()[:] == (sum(range(100_000)) + 7.0, 2)
