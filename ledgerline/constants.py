"""Fixed values. They decide results, so they are stated once and never derived.

Every operator takes the ones it needs as keyword arguments with these defaults.
"""

# --- fixed values: files -----------------------------------------------------
SPREADSHEET_SUFFIXES = [".xlsx", ".xls", ".csv"]
PDF_SUFFIXES = [".pdf"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".tiff"]
HEADER_SEARCH_ROWS = 10

# Cell texts that the usual CSV readers of tabular data take as missing.
MISSING_CELL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: master data -----------------------------------------------
CUSTOMER_KEY = "Customer master ID"
ITEM_KEY = "Item master ID"
CUSTOMER_NAME = "Legal name"
CUSTOMER_ID_COLUMNS = [
    "Supplier master ID", "Customer master ID", "Supplier ID", "Customer ID", "Master ID", "ID",
]
ITEM_KEY_COLUMNS = ["Item ID", "ISBN-13", "Item master ID", "ISBN", "EAN", "Source item no."]
ITEM_ID_COLUMNS = ["Item ID", "Item master ID"]

# --- fixed values: matching --------------------------------------------------
CUSTOMER_CUTOFF = 50.0
ITEM_CUTOFF = 60.0
HEADER_CUTOFF = 80.0
MIN_HEADER_FIELDS = 2
UNKNOWN_COUNTERPARTY = "UNKNOWN"

# Field order matters: an earlier field wins a tie.
COLUMN_ALIASES = {
    "item_number": ["sku", "item id", "part number", "item_number", "article", "code"],
    "raw_description": ["description", "item description", "name", "product", "details", "item"],
    "quantity": ["qty", "quantity", "count", "amount", "pieces"],
    "unit_price": ["unit price", "price", "unit_price", "rate"],
    "total_line_amount": ["total", "line total", "total_amount", "amount", "amount eur",
                          "amount gbp", "total ($)", "total (€)"],
}
FIELDS = list(COLUMN_ALIASES)

# --- fixed values: line filters ----------------------------------------------
JUNK_DESCRIPTIONS = ["qty", "quantity", "unit price", "price", "description", "sku", "item",
                     "item number", "part number", "amount"]
FOOTER_WORDS = ["total", "subtotal", "grand total", "vat", "tax", "amount due"]
OWN_COMPANY_PATTERNS = [r"small book store.*"]
EMAIL = r"[\w\.-]+@[\w\.-]+\.\w+"
ADDRESS = r"\b\d{5}\b|avenue|street|broadway|road"

# --- fixed values: header fields ---------------------------------------------
# Java regex flags: ignore case, only \n ends a line, Unicode classes.
FLAGS = "(?idU)"
DOCUMENT_NUMBER = (r"(?:PURCHASE\s*ORDER|PO|INVOICE|ORDER)[\s#:]*(?:NUMBER|#|NO\.?)?:?\s*"
                   r"([A-Z0-9-]+)")
TAX = r"(?:TAX|VAT|HST)[^:\n]*[:\s]+[\$€£]?\s*([\d.,]+)"
SHIPPING = (r"(?:SHIPPING|FREIGHT|HANDLING|ESTIMATED\s*FREIGHT)[\s\w()]*[:\s|]+[$€£]?\s*"
            r"([\d.,]+)")
TOTAL = (r"\b(?:TOTAL\s*AMOUNT|TOTAL\s*DUE|ORDER\s*TOTAL|GRAND\s*TOTAL|TOTAL)\b[\s:|]+[$€£]?\s*"
         r"([\d.,]+)")
COUNTERPARTY = (r"(?:CUSTOMER|SUPPLIER|VENDOR|CLIENT|BUYER|ISSUED\s*BY|SOLD\s*BY|FROM|BILL\s*TO|"
                r"SHIP\s*TO)[\s:]+([^\n,;]+)")
SPACE_LAYOUT = r"^(.*?)\s+([\d.,]+)\s+([\d.,]+)\s+([\d.,]+)$"
RECIPIENT_MARKERS = ["customer:", "ship to:", "billed to:"]
LETTERHEAD_LINES = 5
LETTERHEAD_MIN_CHARS = 3
LETTERHEAD_TITLES = ["invoice", "purchase order", "po", "order"]

# --- fixed values: arithmetic and rules --------------------------------------
ARITHMETIC_TOLERANCE = 0.01
RULE_TOLERANCE = 0.05
CONFIDENCE_FLOOR = 0.80
EMPTY_TEXT_REASON = "Empty document text provided"
FALLBACK_ATTEMPTS = 3
DOCUMENT_TYPES = ["purchase_order", "invoice", "delivery_note", "unknown"]

# --- sizes of bounded groups (execution only, never part of a result) ---------
ROWS_PER_CHUNK = 100_000
TEXT_ROWS_PER_PART = 5_000
