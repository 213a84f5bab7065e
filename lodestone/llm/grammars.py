"""Grammars of the judged languages, one level of brackets at a time.

A bracketed group is one token that carries what its inside was recognised as, written as the
bracket and a name: '{Block', '(Params'. Operators of one role share a terminal, so an expression is
a flat chain of operands; precedence does not matter for validity. TypeScript is JavaScript with the
rules marked ts.
"""

from __future__ import annotations

_JS = """
word = 'id' | 'async' | 'await' | 'of' | 'get' | 'set' | 'static' | 'let' | 'yield' | 'as' | 'from' | 'type' | 'interface' | 'namespace' | 'module'
  | 'declare' | 'abstract' | 'readonly' | 'keyof' | 'is' | 'infer' | 'satisfies' | 'public' | 'private' | 'protected' | 'override' | 'accessor'
  | 'implements' | 'unique' | 'asserts' | 'out' | 'target' | 'using' | 'global' | 'require'
reserved = 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends'
  | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw'
  | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with'
name = word | reserved
pname = name | 'str' | 'num' | '#priv' | '[Index'
deco = '@' ( word ( '.' name )* '(Args'? | '(Paren' )
binding = word | '[Pat' | '{Pat'
prefix = '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'yield' | 'yield' '*' | 'new'
op = '=' | 'aop' | 'bop' | '+' | '-' | '*' | '<' | '>' | '>' '>+' | '>' '>+' '>+' | '&' | '|' | 'in' | 'instanceof' | '/'
func = 'async'? 'function' '*'? word? tparams '(Params' rettype '{Fn'
class = deco* classmods 'class' word? tparams ( 'extends' Heritage )? implementing '{Class'
funcdecl = 'async'? 'function' '*'? word tparams '(Params' rettype '{Fn'
classdecl = deco* classmods 'class' word tparams ( 'extends' Heritage )? implementing '{Class'
Heritage = ( word | 'this' | 'super' | '(Paren' | 'class' word? '{Class' | func | 'null' ) suffix* targs
suffix = '.' ( name | '#priv' ) | '?.' ( name | '#priv' | '(Args' | '[Index' | 'Tpl' ) | '(Args' | '[Index' | 'Tpl' | tssuffix
primary = word | 'num' | 'str' | 'Tpl' | 'regex' | 'this' | 'super' | 'null' | 'true' | 'false' | '(Paren' | '[Array' | '{Object' | func | class
  | 'import' ( '(Args' | '.' name ) | 'new' '.' name | '#priv'
Arrow = 'async'? ( word | tparams '(Params' rettype ) '=>' ( !'{' Assign | '{Fn' )
operand = prefix* primary suffix* ( '++' | '--' )? tspostfix | prefix* Arrow | 'yield' | tscast
Assign = operand ( op operand )* ( '?' Assign ':' Assign )?
Expr = Assign ( ',' Assign )*
Args = ( '...'? Assign ( ',' '...'? Assign )* ','? )?
Paren = Expr
Index = Expr
Param = deco* parammods '...'? ( binding | tsthis ) tsoptional annotation ( '=' Assign )?
Params = ( Param ( ',' Param )* ','? )?
Array = ( '...'? Assign )? ( ',' ( '...'? Assign )? )*
element = '...'? binding ( '=' Assign )?
Pat_list = element? ( ',' element? )*
patprop = '...' binding | pname ':' binding ( '=' Assign )? | word ( '=' Assign )?
Pat_object = ( patprop ( ',' patprop )* ','? )?
method = ( 'async' | 'async' '*' | '*' | 'get' | 'set' )? pname tsoptional tparams '(Params' rettype '{Fn'
prop = '...' Assign | pname ':' Assign | word ( '=' Assign )? | method
Object = ( prop ( ',' prop )* ','? )?
specname = name | 'str'
spec = spectype specname ( 'as' specname )?
Specs = ( spec ( ',' spec )* ','? )?
member = deco* membermods ( pname tsfield annotation ( '=' Assign )? eos | method ) | 'static' '{Fn' | tsmember | ';'
ClassBody = member*
Switch = ( ( 'case' Expr | 'default' ) ':' Stmt* )*
SwitchFn = ( ( 'case' Expr | 'default' ) ':' StmtFn* )*
ForHead = ( ( 'var' | 'let' | 'const' | 'using' ) declaration ( ',' declaration )* | Expr )? ';' Expr? ';' Expr?
  | ( ( 'var' | 'let' | 'const' | 'using' ) binding annotation | primary suffix* ) ( 'in' | 'of' ) Expr
Catch = binding annotation
eos = ';' | EOS
declaration = binding tsbang annotation ( '=' Assign )?
vars = ( 'var' | 'let' | 'const' | 'using' ) declaration ( ',' declaration )* eos
Stmt = '{Block' | vars | ';' | !'{' !'function' !'class' Expr eos | 'if' '(Paren' Stmt ( 'else' Stmt )? | 'for' 'await'? '(For' Stmt | 'while' '(Paren' Stmt
  | 'do' Stmt 'while' '(Paren' ';'? | 'try' '{Block' ( 'catch' '(Catch'? '{Block' ( 'finally' '{Block' )? | 'finally' '{Block' ) | 'switch' '(Paren' '{Switch'
  | ( 'break' | 'continue' ) word? eos | 'throw' Expr eos | 'debugger' eos | word ':' Stmt | 'with' '(Paren' Stmt | funcdecl | classdecl | tsstmt
StmtFn = '{BlockFn' | vars | ';' | !'{' !'function' !'class' Expr eos | 'if' '(Paren' StmtFn ( 'else' StmtFn )? | 'for' 'await'? '(For' StmtFn | 'while' '(Paren' StmtFn
  | 'do' StmtFn 'while' '(Paren' ';'? | 'try' '{BlockFn' ( 'catch' '(Catch'? '{BlockFn' ( 'finally' '{BlockFn' )? | 'finally' '{BlockFn' )
  | 'switch' '(Paren' '{SwitchFn' | ( 'break' | 'continue' ) word? eos | 'throw' Expr eos | 'debugger' eos | word ':' StmtFn | 'with' '(Paren' StmtFn
  | 'return' Expr? eos | funcdecl | classdecl | tsstmt
Stmts = Stmt*
StmtsFn = StmtFn*
source = 'from' 'str' ( 'with' '{Object' )?
import = 'import' ( spectype ( word ( ',' ( '*' 'as' word | '{Specs' ) )? | '*' 'as' word | '{Specs' ) source | 'str' ( 'with' '{Object' )? | tsimport ) eos
export = 'export' ( '*' ( 'as' specname )? source eos | spectype '{Specs' source? eos | 'default' ( func | class | !'function' !'class' Assign eos | tsdefault )
  | vars | funcdecl | classdecl | tsstmt | tsexport )
Item = Stmt | import | export
Items = Item*
Script = Stmt*
CommonScript = StmtFn*
Template = Expr ( '}$' Expr )*
"""

_PLAIN = """
tparams = none
targs = none
rettype = none
annotation = none
classmods = none
implementing = none
tssuffix = 'never'
tspostfix = none
tscast = 'never'
parammods = none
tsthis = 'never'
tsoptional = none
spectype = none
membermods = ( 'static' | 'accessor' )*
tsfield = none
tsmember = 'never'
tsbang = none
tsstmt = 'never'
tsimport = 'never'
tsdefault = 'never'
tsexport = 'never'
none = ( 'never' )?
"""

_TS = """
none = ( 'never' )?
tparam = ( 'const' | 'in' | 'out' )* word ( 'extends' Type )? ( '=' Type )?
tclose = '>' | '>+'
tparams = ( '<' tparam ( ',' tparam )* ','? tclose )?
Targs = '<' Type ( ',' Type )* ','? tclose
targs = Targs?
annotation = ( ':' Type )?
rettype = ( ':' ( Type | predicate ) )?
predicate = 'asserts'? ( word | 'this' ) ( 'is' Type )?
Member_type = ( word | 'this' | 'typeof' ( word | 'this' | 'import' '(Args' ) | 'import' '(Args' ) ( '.' name )* targs
  | 'void' | 'null' | 'true' | 'false' | 'str' | 'num' | '-' 'num' | 'TypeTpl' | '(PType' | '[Tuple' | '{Type' | '{Mapped'
unary_type = ( 'keyof' | 'readonly' | 'unique' | 'infer' )* Member_type ( '[Empty' | '[IndexType' )*
Function_type = 'abstract'? 'new'? tparams '(Params' '=>' ( Type | predicate )
Type = ( '|' | '&' )? ( unary_type | Function_type ) ( ( '|' | '&' ) ( unary_type | Function_type ) )* ( 'extends' Type ( '?' Type ':' Type )? )?
PType = Type
Tuple = ( tupleitem ( ',' tupleitem )* ','? )?
tupleitem = '...'? ( word '?'? ':' )? Type '?'?
IndexType = Type
IndexSig = word ':' Type
MapKey = word 'in' Type ( 'as' Type )?
sep = ';' | ',' | EOS
tmember = deco* ( 'readonly' )? ( pname '?'? annotation sep | ( 'get' | 'set' )? pname '?'? tparams '(Params' rettype sep | 'new'? tparams '(Params' rettype sep
  | '[IndexSig' annotation sep )
TypeBody = tmember*
MappedBody = ( ( '+' | '-' )? 'readonly' )? '[MapKey' ( ( '+' | '-' )? '?' )? annotation ( ';' | ',' )?
EnumBody = ( pname ( '=' Assign )? ( ',' pname ( '=' Assign )? )* ','? )?
classmods = ( 'abstract' | 'declare' )*
implementing = ( 'implements' Member_type ( ',' Member_type )* )?
tssuffix = '!' | Targs ( '(Args' | 'Tpl' )
tspostfix = ( ( 'as' | 'satisfies' ) ( Type | 'const' ) )*
tscast = '<' Type tclose prefix* primary suffix*
parammods = ( 'public' | 'private' | 'protected' | 'readonly' | 'override' )*
tsthis = 'this'
tsoptional = '?'?
spectype = 'type'?
membermods = ( 'static' | 'accessor' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'declare' | 'override' )*
tsfield = ( '?' | '!' )?
tsmember = membermods ( ( 'async' | 'get' | 'set' | '*' )? pname tsoptional tparams '(Params' rettype eos | '[IndexSig' annotation eos )
tsbang = '!'?
iface = 'interface' word tparams ( 'extends' Member_type ( ',' Member_type )* )? '{Type'
tsstmt = iface | 'type' word tparams '=' Type eos | 'const'? 'enum' word '{Enum' | ( 'namespace' | 'module' ) ( word ( '.' name )* | 'str' ) '{Module' | 'global' '{Module'
  | 'declare' ( vars | 'async'? 'function' '*'? word tparams '(Params' rettype eos | classdecl | iface | 'type' word tparams '=' Type eos | 'const'? 'enum' word '{Enum'
  | ( 'namespace' | 'module' ) ( word ( '.' name )* | 'str' ) ( '{Module' | eos ) | 'global' '{Module' )
  | 'async'? 'function' '*'? word tparams '(Params' rettype eos
tsimport = 'type'? word '=' ( 'require' '(Args' | word ( '.' name )* )
tsdefault = iface | 'abstract' 'class' word? tparams '{Class'
tsexport = '=' Expr eos | 'as' 'namespace' word eos | 'import' word '=' ( 'require' '(Args' | word ( '.' name )* ) eos
Type_template = Type ( '}$' Type )*
"""

_PY = """
word = 'id' | 'match' | 'case' | 'type' | '_'
dotted = word ( '.' word )*
Lambda_args = ( ( '*' word? | '**' word | word ( '=' Test )? | '/' ) ( ',' ( '*' word? | '**' word | word ( '=' Test )? | '/' ) )* ','? )?
atom = word | 'num' | 'str' 'str'* | '(Group' | '[List' | '{Set' | '...' | 'None' | 'True' | 'False'
trailer = '.' word | '(Args' | '[Index'
unary = ( 'not' | '-' | '+' | '~' | 'await' )*
op = 'bop' | '/' | '|' | '+' | '-' | '*' | '**' | '@' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' | 'is' 'not'
Test = unary atom trailer* ( op unary atom trailer* )* ( 'if' Test_plain 'else' Test )? | 'lambda' Lambda_args ':' Test
Test_plain = unary atom trailer* ( op unary atom trailer* )* | 'lambda' Lambda_args ':' Test
starred = '*' Or_flat | Test
Or_flat = unary atom trailer* ( op unary atom trailer* )*
named = word ':=' Test | starred
exprs = starred ( ',' starred )* ','?
yielding = 'yield' ( 'from' Test | exprs )?
target = '*'? ( word | ( word | 'str' | 'None' | 'True' | 'False' | 'num' | '(Group' | '[List' | '{Set' | '...' ) trailer* ( '.' word | '[Index' ) | '(Target' | '[Target' )
targets = target ( ',' target )* ','?
comp = ( 'async'? 'for' targets 'in' Or_plain ( 'if' Cond )* )+
Or_plain = Or_flat | 'lambda' Lambda_args ':' Test
Cond = word ':=' Or_flat | Or_plain | Test_plain
Group = ( yielding | named comp | named ( ',' named )* ','? )?
List = ( named comp | named ( ',' named )* ','? )?
pair = Test ':' Test | '**' Or_flat
Dict = ( pair comp | pair ( ',' pair )* ','? )?
Set = named comp | named ( ',' named )* ','?
slice = Test? ':' Test? ( ':' Test? )? | named
Index = slice ( ',' slice )* ','?
plain = '*' Test | word ':=' Test | Test
keyed = word '=' Test | '*' Test
spread = word '=' Test | '**' Test
Args = ( ( plain ( ',' plain )* ( ',' keyed )* ( ',' spread )* | keyed ( ',' keyed )* ( ',' spread )* | spread ( ',' spread )* ) ','? | Test comp | word ':=' Test comp )?
bare = word ( ':' Test )? | '/'
filled = word ( ':' Test )? '=' Test | '/'
rest = '*' ( word ( ':' starred )? )? ( ',' word ( ':' Test )? ( '=' Test )? )* ( ',' '**' word ( ':' Test )? )? ','? | '**' word ( ':' Test )? ','?
Params = ( bare ',' )* ( bare? | ( filled ',' )* ( filled? | rest ) )
Target = ( targets )?
alias = word ( 'as' word )?
Names = alias ( ',' alias )* ','?
withitem = Test ( 'as' target )?
With = withitem ( ',' withitem )* ','?
TypeParams = ( ( '*' | '**' )? word ( ':' Test )? ( '=' starred )? ( ',' ( '*' | '**' )? word ( ':' Test )? ( '=' starred )? )* ','? )
small = exprs | yielding | ( targets '=' )+ ( exprs | yielding ) | target 'aop' ( exprs | yielding ) | target ':' Test ( '=' ( exprs | yielding ) )?
  | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' ( Test ( 'from' Test )? )? | ( 'global' | 'nonlocal' ) word ( ',' word )* | 'del' targets
  | 'assert' Test ( ',' Test )? | 'import' dotted ( 'as' word )? ( ',' dotted ( 'as' word )? )*
  | 'from' ( ( '.' | '...' )* dotted | ( '.' | '...' )+ ) 'import' ( '*' | alias ( ',' alias )* | '(Names' ) | 'type' word '[TypeParams'? '=' Test
Small = small
Simple = Small ( ';' Small )* ';'?
guard = ( 'if' named )?
pattern = ( '*' word | Pattern ) ( ',' ( '*' word | Pattern ) )* ','?
Pattern = patom ( '|' patom )* ( 'as' word )?
patom = '-'? 'num' ( ( '+' | '-' ) 'num' )? | 'str' 'str'* | 'None' | 'True' | 'False' | dotted '(Cpat'? | '(Gpat' | '[Gpat' | '{Mpat'
Gpat = ( pattern )?
cpat = ( word '=' )? Pattern
Cpat = ( cpat ( ',' cpat )* ','? )?
mpat = ( '-'? 'num' | 'str' 'str'* | 'None' | 'True' | 'False' | word ( '.' word )+ ) ':' Pattern | '**' word
Mpat = ( mpat ( ',' mpat )* ','? )?
Simple_line = Simple
If_line = 'if' named ':' Simple?
Elif_line = 'elif' named ':' Simple?
Else_line = 'else' ':' Simple?
While_line = 'while' named ':' Simple?
For_line = 'async'? 'for' targets 'in' exprs ':' Simple?
Try_line = 'try' ':' Simple?
Except_line = 'except' '*'? ( Test ( ',' Test )* ( 'as' word )? )? ':' Simple?
Finally_line = 'finally' ':' Simple?
With_line = 'async'? 'with' ( withitem ( ',' withitem )* | '(With' ) ':' Simple?
Def_line = 'async'? 'def' word '[TypeParams'? '(Params' ( '->' Test )? ':' Simple?
Class_line = 'class' word '[TypeParams'? '(Args'? ':' Simple?
Deco_line = '@' named
Match_line = 'match' exprs ':'
Case_line = 'case' pattern guard ':' Simple?
if = ( 'If' Body | 'If1' ) ( 'Elif' Body | 'Elif1' )* else
else = ( 'Else' Body | 'Else1' )?
try = ( 'Try' Body | 'Try1' ) ( ( 'Except' Body | 'Except1' )+ else ( 'Finally' Body | 'Finally1' )? | 'Finally' Body | 'Finally1' )
Body = 'Blk'
stmt = 'Simple' | if | ( 'While' Body | 'While1' | 'For' Body | 'For1' ) else | try | 'With' Body | 'With1' | 'Deco'* ( 'Def' Body | 'Def1' | 'Class' Body | 'Class1' )
  | 'Match' 'CaseBlk'
File = ( stmt )*
Block = stmt ( stmt )*
Cases = ( 'Case' Body | 'Case1' )+
"""

_GO = """
qualified = 'id' ( '.' 'id' )?
Type = qualified ( '[TypeArgs' )? | '*' Type | ( '[Empty' | '[Len' | '[Auto' ) Type | 'map' '[TypeArgs' Type | 'chan' '<-'? Type | '<-' 'chan' Type
  | 'func' '(Params' result | 'struct' '{Struct' | 'interface' '{Interface' | '(TypeParen'
result = ( Type | '(Params' )?
TypeArgs = Type ( ',' Type )* ','?
Len = Expr
Auto = '...'
TypeParen = Type
param = 'id'? '...'? Type | 'id'
Params = ( param ( ',' param )* ','? )?
tparam = 'id' ( ',' 'id' )* Constraint
Constraint = '~'? Type ( 'bop' '~'? Type )*
TypeParams = tparam ( ',' tparam )* ','?
Struct = ( 'id' ( ',' 'id' )* Type 'str'? ';' | '*'? qualified '[TypeArgs'? 'str'? ';' )* ( 'id' ( ',' 'id' )* Type 'str'? | '*'? qualified '[TypeArgs'? 'str'? )?
imember = 'id' '(Params' result | Constraint
Interface = ( imember ';' )* imember?
unary = ( '+' | '-' | '!' | '^' | '*' | '&' | '<-' )*
operand = 'num' | 'str' | 'id' | 'func' '(Params' result '{Block' | '(Paren' | '(TypeParen' '(Args' | typelit '{Composite' | typelit '(Args'
typelit = ( '[Empty' | '[Len' | '[Auto' ) Type | 'map' '[TypeArgs' Type | 'struct' '{Struct' | 'chan' Type | 'interface' '{Interface'
suffix = '.' 'id' | '.' '(TypeParen' | '.' '(TypeKey' | '[Index' | '[TypeArgs' | '(Args' | '{Composite'
op = 'bop' | '+' | '-' | '*' | '&' | '^'
Expr = unary operand suffix* ( op unary operand suffix* )*
TypeKey = 'type'
Paren = Expr
arg = Expr | Type
Args = ( arg ( ',' arg )* '...'? ','? )?
Index = Expr | Expr? ':' Expr? ( ':' Expr )?
element = Expr | '{Composite'
Composite = ( element ( ':' element )? ( ',' element ( ':' element )? )* ','? )?
exprs = Expr ( ',' Expr )*
simple = exprs ( ( '=' | ':=' | 'aop' ) exprs | '++' | '--' | '<-' Expr )?
if = 'if' ( simple? ';' )? Expr '{Block' ( 'else' ( If | '{Block' ) )?
If = if
for = 'for' ( simple? ';' Expr? ';' simple? | Expr | ( exprs ( '=' | ':=' ) )? 'range' Expr )? '{Block'
switch = 'switch' ( simple? ';' )? ( simple )? '{Cases'
Simple = simple
spec = 'id' ( ',' 'id' )* ( Type ( '=' exprs )? | '=' exprs )
cspec = 'id' ( ',' 'id' )* ( Type? '=' exprs )?
tspec = 'id' ( '[TypeParams' )? '='? Type
declaration = 'var' ( spec | '(Vars' ) | 'const' ( cspec | '(Consts' ) | 'type' ( tspec | '(Types' )
Vars = ( spec ';' )* spec?
Consts = ( cspec ';' )* cspec?
Types = ( tspec ';' )* tspec?
Stmt = Simple | declaration | if | for | switch | 'select' '{Cases' | ( 'go' | 'defer' ) Expr | 'return' exprs? | ( 'break' | 'continue' ) 'id'? | 'goto' 'id'
  | 'fallthrough' | '{Block' | 'id' ':' Stmt?
Block = Stmt? ( ';' Stmt? )*
Cases = ( ( 'case' ( caselist | simple ) | 'default' ) ':' Block )*
caselist = arg ( ',' arg )*
import = ( '.' | 'id' )? 'str'
Imports = ( import ';' )* import?
method = 'func' '(Params'? 'id' '[TypeParams'? '(Params' result '{Block'?
File = 'package' 'id' ';' ( 'import' ( import | '(Imports' ) ';' )* ( ( declaration | method ) ';' )*
Top = ( ( declaration | method ) ';' )*
"""

_JSON = """
value = 'str' | 'lit' | '{Object' | '[Array'
Object = ( 'str' ':' value ( ',' 'str' ':' value )* )?
Array = ( value ( ',' value )* )?
File = value
"""

JAVASCRIPT, TYPESCRIPT, PYTHON, GO, JSON = _JS + _PLAIN, _JS + _TS, _PY, _GO, _JSON
