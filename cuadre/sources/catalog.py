"""Field catalogue (S10-S12): field definitions, synonyms per ERP, learned patterns.

The built-in default catalogue below is seed data (S11). A larger catalogue can be loaded from a YAML file of the
same shape (``load_yaml_catalogue``); only its *rows* enter Spark, as a small table that is broadcast to the
name-matching join (its size is the catalogue's, never the data's).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: built-in field definitions (code, display name, data type)
FIELD_DEFINITIONS = [
    ("journal_entry_id", "ID del Asiento Contable", "numeric"),
    ("line_number", "Número de Línea del Asiento", "numeric"),
    ("description", "Descripción del Encabezado", "text"),
    ("line_description", "Descripción de la Línea", "text"),
    ("posting_date", "Fecha de Contabilización", "date"),
    ("fiscal_year", "Año Fiscal", "numeric"),
    ("period_number", "Número de Período", "numeric"),
    ("gl_account_number", "Número de Cuenta Contable", "alphanumeric"),
    ("gl_account_name", "Nombre de la Cuenta Contable", "text"),
    ("amount", "Importe", "numeric"),
    ("debit_amount", "Importe Debe", "numeric"),
    ("credit_amount", "Importe Haber", "numeric"),
    ("debit_credit_indicator", "Indicador Debe/Haber", "text"),
    ("vendor_id", "ID del Proveedor/Tercero", "alphanumeric"),
    ("prepared_by", "Preparado Por", "text"),
    ("entry_date", "Fecha de Entrada", "date"),
    ("entry_time", "Hora de Entrada", "text"),
    ("document_number", "Número de Documento", "alphanumeric"),
]

# fixed values: built-in synonyms (field, ERP, name, confidence boost), in definition order
SYNONYMS = [
    ("journal_entry_id", "Generic_ES", "Asiento", 0.9), ("journal_entry_id", "Generic_ES", "NumAsiento", 0.95),
    ("journal_entry_id", "Generic_ES", "ID_Asiento", 0.9), ("journal_entry_id", "SAP", "BELNR", 0.95),
    ("journal_entry_id", "Oracle", "je_header_id", 0.9), ("journal_entry_id", "Navision", "document_no", 0.8),
    ("line_number", "Generic_ES", "Linea", 0.9), ("line_number", "Generic_ES", "NumLinea", 0.95),
    ("line_number", "Generic_ES", "LineaAsiento", 0.9), ("line_number", "SAP", "BUZEI", 0.95),
    ("line_number", "Oracle", "je_line_num", 0.9),
    ("description", "Generic_ES", "Concepto", 0.9), ("description", "Generic_ES", "ConceptoAsiento", 0.95),
    ("description", "Generic_ES", "DescripcionCabecera", 0.9), ("description", "SAP", "BKTXT", 0.9),
    ("description", "Oracle", "description", 0.8),
    ("line_description", "Generic_ES", "DescripcionLinea", 0.9), ("line_description", "Generic_ES", "DetalleLinea", 0.8),
    ("line_description", "SAP", "SGTXT", 0.9), ("line_description", "Oracle", "line_description", 0.8),
    ("posting_date", "Generic_ES", "Fecha", 0.9), ("posting_date", "Generic_ES", "FechaAsiento", 0.95),
    ("posting_date", "Generic_ES", "FechaContabilizacion", 0.9), ("posting_date", "SAP", "BUDAT", 0.95),
    ("posting_date", "Oracle", "effective_date", 0.9), ("posting_date", "Navision", "posting_date", 0.9),
    ("fiscal_year", "Generic_ES", "Año", 0.8), ("fiscal_year", "Generic_ES", "AñoFiscal", 0.95),
    ("fiscal_year", "Generic_ES", "Ejercicio", 0.9), ("fiscal_year", "SAP", "GJAHR", 0.95),
    ("fiscal_year", "Oracle", "period_year", 0.8),
    ("period_number", "Generic_ES", "Periodo", 0.9), ("period_number", "Generic_ES", "Mes", 0.8),
    ("period_number", "Generic_ES", "PeriodoContable", 0.95), ("period_number", "SAP", "MONAT", 0.95),
    ("period_number", "Oracle", "period_num", 0.9),
    ("gl_account_number", "Generic_ES", "Cuenta", 0.9), ("gl_account_number", "Generic_ES", "CuentaContable", 0.95),
    ("gl_account_number", "Generic_ES", "CodigoCuenta", 0.9), ("gl_account_number", "SAP", "HKONT", 0.95),
    ("gl_account_number", "Oracle", "account", 0.8), ("gl_account_number", "Navision", "g_l_account_no", 0.9),
    ("gl_account_name", "Generic_ES", "NombreCuenta", 0.95), ("gl_account_name", "Generic_ES", "DescripcionCuenta", 0.9),
    ("gl_account_name", "Generic_ES", "DenominacionCuenta", 0.8), ("gl_account_name", "SAP", "TXT50", 0.9),
    ("gl_account_name", "Oracle", "account_description", 0.8), ("gl_account_name", "Navision", "account_name", 0.8),
    ("amount", "Generic_ES", "Importe", 0.95), ("amount", "Generic_ES", "Saldo", 0.9),
    ("amount", "Generic_ES", "Total", 0.8), ("amount", "SAP", "DMBTR", 0.95), ("amount", "Oracle", "entered_amount", 0.8),
    ("debit_amount", "Generic_ES", "Debe", 0.95), ("debit_amount", "Generic_ES", "ImporteDebe", 0.9),
    ("debit_amount", "Generic_ES", "Debito", 0.8), ("debit_amount", "SAP", "SOLLBETRAG", 0.9),
    ("debit_amount", "Oracle", "entered_dr", 0.9), ("debit_amount", "Navision", "debit_amount", 0.9),
    ("credit_amount", "Generic_ES", "Haber", 0.95), ("credit_amount", "Generic_ES", "ImporteHaber", 0.9),
    ("credit_amount", "Generic_ES", "Credito", 0.8), ("credit_amount", "SAP", "HABENBETRAG", 0.9),
    ("credit_amount", "Oracle", "entered_cr", 0.9), ("credit_amount", "Navision", "credit_amount", 0.9),
    ("debit_credit_indicator", "Generic_ES", "IndicadorDH", 0.9), ("debit_credit_indicator", "Generic_ES", "DebeHaber", 0.8),
    ("debit_credit_indicator", "SAP", "SHKZG", 0.95), ("debit_credit_indicator", "Oracle", "dc_indicator", 0.8),
    ("vendor_id", "Generic_ES", "Proveedor", 0.9), ("vendor_id", "Generic_ES", "IDProveedor", 0.95),
    ("vendor_id", "Generic_ES", "CodigoProveedor", 0.9), ("vendor_id", "Generic_ES", "Tercero", 0.8),
    ("vendor_id", "SAP", "LIFNR", 0.95), ("vendor_id", "Oracle", "vendor_id", 0.9), ("vendor_id", "Navision", "vendor_no", 0.8),
    ("prepared_by", "Generic_ES", "Usuario", 0.8), ("prepared_by", "Generic_ES", "PreparadoPor", 0.95),
    ("prepared_by", "Generic_ES", "CreadoPor", 0.9), ("prepared_by", "SAP", "USNAM", 0.9),
    ("prepared_by", "Oracle", "created_by", 0.8),
    ("entry_date", "Generic_ES", "FechaEntrada", 0.95), ("entry_date", "Generic_ES", "FechaCreacion", 0.9),
    ("entry_date", "Generic_ES", "FechaCaptura", 0.8), ("entry_date", "SAP", "CPUDT", 0.9),
    ("entry_date", "Oracle", "creation_date", 0.8),
    ("entry_time", "Generic_ES", "HoraEntrada", 0.95), ("entry_time", "Generic_ES", "HoraCreacion", 0.9),
    ("entry_time", "SAP", "CPUTM", 0.9), ("entry_time", "Oracle", "creation_time", 0.8),
    ("document_number", "Generic_ES", "NumDoc", 0.9), ("document_number", "Generic_ES", "NumDocumento", 0.95),
    ("document_number", "Generic_ES", "Documento", 0.8), ("document_number", "SAP", "XBLNR", 0.95),
    ("document_number", "Oracle", "reference", 0.8),
]

ERPS = ["Generic_ES", "Navision", "Oracle", "SAP", "SAGE"]  # fixed value: ERP groups of the catalogue

SYNONYM_SCHEMA = ("field_type string, erp string, name string, boost double, syn_order int, language string, "
                  "deprecated boolean")
FIELD_SCHEMA = "field_type string, display_name string, data_type string, field_order int, active boolean"


def field_definitions(spark: SparkSession, rows=None) -> DataFrame:
    rows = rows if rows is not None else FIELD_DEFINITIONS
    return spark.createDataFrame([(c, n, t, i, True) for i, (c, n, t) in enumerate(rows)], FIELD_SCHEMA)


def synonyms(spark: SparkSession, rows=None) -> DataFrame:
    """Exploded synonym table (field_type, erp, name, boost, syn_order, language, deprecated)."""
    rows = rows if rows is not None else SYNONYMS
    return spark.createDataFrame([(f, e, n, float(b), i, None, False) for i, (f, e, n, b) in enumerate(rows)],
                                 SYNONYM_SCHEMA)


def load_yaml_catalogue(path: str):
    """Read a catalogue YAML (fields -> synonyms_by_erp -> [{name, confidence_boost}]) into seed rows.

    Returns (field rows, synonym rows) for ``field_definitions`` / ``synonyms``. Requires PyYAML."""
    try:
        import yaml  # noqa: PLC0415
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("PyYAML is needed to read a catalogue file") from e
    with open(path, encoding="utf-8") as fh:
        cfg = yaml.safe_load(fh) or {}
    fields, syns = [], []
    for code, fd in (cfg.get("fields") or cfg.get("field_definitions") or {}).items():
        if not fd or not fd.get("active", True):
            continue
        fields.append((code, fd.get("name", code), fd.get("data_type", "text")))
        for erp, lst in (fd.get("synonyms_by_erp") or fd.get("synonyms") or {}).items():
            for s in lst or []:
                if isinstance(s, str):
                    syns.append((code, erp, s, 0.0))
                else:
                    syns.append((code, erp, s.get("name"), float(s.get("confidence_boost", 0.0))))
    return fields, syns


def valid_synonyms(syn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P20 on synonym rows: non-empty name, boost in [0, 1], known field code shape. Returns (valid, rejected with
    a ``reason``)."""
    reason = (F.when(F.col("name").isNull() | (F.trim(F.col("name")) == ""), F.lit("empty name"))
               .when((F.col("boost") < 0) | (F.col("boost") > 1), F.lit("boost outside [0,1]"))
               .when(~F.col("field_type").rlike(r"^[a-z][a-z0-9_]*$"), F.lit("invalid field code")))
    tagged = syn.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


#: fixed values: data types of field definitions
FIELD_TYPES = ["numeric", "text", "date", "time", "datetime", "alphanumeric", "currency", "percentage", "boolean", "email", "url", "phone"]


def valid_fields(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P20 on field definitions: a well-formed code, used once, a name and a known type. Returns (valid, rejected with
    a ``reason``)."""
    from pyspark.sql import Window
    again = F.row_number().over(Window.partitionBy("field_type").orderBy("field_order")) > 1
    reason = (F.when(F.col("field_type").isNull() | ~F.col("field_type").rlike(r"^[a-z][a-z0-9_]*$"), F.lit("invalid field code"))
               .when(F.col("display_name").isNull() | (F.trim("display_name") == ""), F.lit("empty name"))
               .when(~F.coalesce(F.col("data_type").isin(*FIELD_TYPES), F.lit(False)), F.lit("unknown type"))
               .when(again, F.lit("code used twice")))
    tagged = fields.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())
