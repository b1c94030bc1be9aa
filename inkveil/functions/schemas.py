"""Explicit schemas of the tables that the operators read and write."""

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SYMBOL = f"struct<text:string,bbox:{BBOX}>"
WORD = f"struct<text:string,bbox:{BBOX},symbols:array<{SYMBOL}>>"
LINES = f"array<struct<words:array<{WORD}>>>"
UNIT = f"struct<ch:string,bbox:{BBOX},raw:string,bbox_source:string>"
STYLE = "struct<mode:string,color:string>"

IMAGES = "image_id string, path string, width int, height int, data binary"
TARGETS = "target_id string, target_raw string"
OCR_PAGES = f"image_id string, pass string, pass_ix int, scale double, off_x double, off_y double, text string, lines {LINES}"
#: ``crop`` is in the pixels of what the variant is cut from: the enlarged page (ocr), the analysed page (analysed), the image (others).
OCR_REQUESTS = f"image_id string, target_id string, request_id string, kind string, group_ix int, attempt_ix int, variant string, psm int, zoom int, crop {BBOX}"
OCR_REPLIES = f"request_id string, text string, lines {LINES}, error string"
TEMPLATES = "target_id string, target_height int, skew double, w int, h int, samples array<struct<x:int,y:int>>, bg_samples array<struct<x:int,y:int>>"
EDIT_EVENTS = f"image_id string, seq long, op string, stamp_ix int, x double, y double, w double, h double, dx double, dy double, handle string, style {STYLE}"
STAMPS = f"image_id string, stamp_ix int, x double, y double, w double, h double, kind string, style {STYLE}"
POINTERS = f"image_id string, seq long, kind string, pointer_id int, pointer_type string, is_primary boolean, buttons int, x double, y double, left double, top double, scale_x double, scale_y double, base_scale double, mode string, stamping boolean, style {STYLE}"
