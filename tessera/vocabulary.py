"""IRIs of the public vocabularies in use."""

# Names that the vocabularies define.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TREE = "https://w3id.org/tree#"
LDES = "https://w3id.org/ldes#"
DCT = "http://purl.org/dc/terms/"
PROV = "http://www.w3.org/ns/prov#"
GEO = "http://www.opengis.net/ont/geosparql#"
SF = "http://www.opengis.net/ont/sf#"
GEOJSON = "https://purl.org/geojson/vocab#"
LOCN = "http://www.w3.org/ns/locn#"
CRS84 = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"
RDF_TYPE = RDF + "type"
XSD_STRING = XSD + "string"
XSD_DATETIME = XSD + "dateTime"
LANG_STRING = RDF + "langString"
VERSION_OF = DCT + "isVersionOf"
GENERATED_AT = PROV + "generatedAtTime"
