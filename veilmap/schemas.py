"""Explicit schemas of imported files."""

SUBJECTS = "image_id string, path string, lat double, lon double, gt_country string, gt_code string"
POINTS = "IMG_ID string, LAT double, LON double"
GALLERY = "label string, gps array<double>, text string, ref_image string"
INSTANCE = "struct<bbox:array<double>,score:double,source:string,mask_rle:struct<size:array<int>,counts:array<int>>,degenerate:boolean>"
CUES = (
    "image_id string, image_size array<int>, geo_privacy_cues array<struct<cue:string,category:string,is_text:boolean,"
    f"reasoning:string,confidence:double,instances:array<{INSTANCE}>,maskable:boolean,degenerate:boolean>>"
)
LATTICE = (
    "image_id string, true_label string, posterior map<string,double>, "
    "cue_meta array<struct<cue:string,category:string,risk:string>>, "
    "combos array<struct<subset:array<int>,cues:array<string>,prior:map<string,double>,kl_bits:double,prior_prob_true:double>>"
)
SWEEP = (
    "image_id string, true_label string, country_hit boolean, km_error double, n_cues int, mpl_all double, "
    "posterior map<string,double>, prior_allmask map<string,double>, "
    "per_cue array<struct<cue:string,category:string,mpl:double,prior:map<string,double>>>"
)
