"""An invented gazetteer: places, names of places that are words too, and organisations, as the data that operators.places takes."""

#: (geo_id, parent, name, postal codes and names that stand for the place).
PLACES = [
    ("XA", None, "Erlenland", ()),
    ("XB", None, "Tannmark", ()),
    ("XA-1100", "XA", "Steg", ("1100", "1101", "stadt steg")),
    ("XA-1112", "XA", "Lindau an der Furt", ("1112", "lindau an der furt")),
    ("XA-1140", "XA", "Birkau", ("1140", "1141", "birkau", "birkenau")),
    ("XB-2000", "XB", "Tannstadt", ("tannstadt", *(str(code) for code in range(2000, 2100)))),
    ("XB-2130", "XB", "Hohl am Rain", ("2130", "hohl am rain")),
]

#: (name, adjective, region, town, idioms, cues of the region, cues of the town).
AMBIGUOUS = [("steg", "steger", "XA", "XA-1100", r"über\s+den\s+steg|am\s+steg\s+entlang", r"land\s+steg|landgericht|landamt", r"11[0-9]{2}\s+steg|fach\s+[0-9]+\s+steg")]

#: (org_id, name, seat, jurisdiction, names and addresses that stand for it).
ORGANISATIONS = [
    ("org_furtbank", "Furtbank", "XA-1100", "XA", ("furtbank", "furt bank", "uferweg 1 1100 steg")),
    ("org_botenpost", "Botenpost AG", "XC-3030", "XC", ("botenpost",)),
    ("org_quellwerk", "Quellwerk Erlen AG", "XA-1112", "XA", ("quellwerk erlen ag", "quellwerk erlen")),
    ("org_landgericht", "Landgericht Steg", "XA-1100", "XA", ("landgericht steg", "kirchgasse 12 1100 steg")),
]
