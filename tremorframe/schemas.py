"""Tables of the relational catalog, and the rows that flow between operators."""

from __future__ import annotations

from pyspark.sql import types as T

#: What the flat format has for nulls.
NULL_INT, NULL_REAL, NULL_TIME, NULL_TEXT = -1, -999.0, -9999999999.999, "-"

#: Columns of the catalog; i integer, r real, t text.
CATALOG = {
    "event": "evid:i evname:t prefor:i auth:t commid:i lddate:t",
    "origin": "lat:r lon:r depth:r time:r orid:i evid:i jdate:i nass:i ndef:i ndp:i grn:i srn:i etype:t depdp:r dtype:t mb:r mbid:i ms:r msid:i ml:r mlid:i algorithm:t auth:t commid:i lddate:t",
    "origerr": "orid:i sxx:r syy:r szz:r stt:r sxy:r sxz:r syz:r stx:r sty:r stz:r sdobs:r smajax:r sminax:r strike:r sdepth:r stime:r conf:r commid:i lddate:t",
    "arrival": "sta:t time:r arid:i jdate:i stassid:i chanid:i chan:t iphase:t stype:t deltim:r azimuth:r delaz:r slow:r delslo:r ema:r rect:r amp:r per:r logat:r clip:t fm:t snr:r qual:t auth:t commid:i lddate:t",
    "assoc": "arid:i orid:i sta:t phase:t belief:r delta:r seaz:r esaz:r timeres:r timedef:t azres:r azdef:t slores:r slodef:t emares:r wgt:r vmodel:t commid:i lddate:t",
    "netmag": "magid:i net:t orid:i evid:i magtype:t nsta:i magnitude:r uncertainty:r auth:t commid:i lddate:t",
    "stamag": "magid:i ampid:i sta:t arid:i orid:i evid:i phase:t delta:r magtype:t magnitude:r uncertainty:r auth:t commid:i lddate:t",
    "site": "sta:t ondate:i offdate:i lat:r lon:r elev:r staname:t statype:t refsta:t dnorth:r deast:r lddate:t",
    "sitechan": "sta:t chan:t ondate:i chanid:i offdate:i ctype:t edepth:r hang:r vang:r descrip:t lddate:t",
    "affiliation": "net:t sta:t lddate:t",
    "wfdisc": "sta:t chan:t time:r wfid:i chanid:i jdate:i endtime:r nsamp:i samprate:r calib:r calper:r instype:t segtype:t datatype:t clip:t dir:t dfile:t foff:i commid:i lddate:t",
    "remark": "commid:i lineno:i remark:t lddate:t",
    "css30_meta": "key:t value:t",
}
KEYS = {"event": ["evid"], "origin": ["orid"], "origerr": ["orid"], "arrival": ["arid"], "assoc": ["arid", "orid"], "netmag": ["magid"], "stamag": ["magid", "sta"], "site": ["sta", "ondate"], "sitechan": ["chanid"], "affiliation": ["net", "sta"], "wfdisc": ["wfid"], "remark": ["commid", "lineno"], "css30_meta": ["key"]}
#: (table, column) -> (table, column) that must have it.
REFERENCES = {("origin", "evid"): ("event", "evid"), ("origerr", "orid"): ("origin", "orid"), ("assoc", "orid"): ("origin", "orid"), ("assoc", "arid"): ("arrival", "arid"), ("netmag", "orid"): ("origin", "orid"), ("stamag", "magid"): ("netmag", "magid")}
_TYPES = {"i": T.LongType(), "r": T.DoubleType(), "t": T.StringType()}


def columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in CATALOG[table].split()]


def schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns(table)])


SEGMENTS = "net string, sta string, loc string, chan string, start_us long, sample_rate double, samples array<double>"
PICKS = "pick_id long, net string, sta string, loc string, chan string, time_us long, phase string, quality int, amplitude double, period double, snr double, uncertainty double, is_automatic boolean, method string"
